"""Installing, publishing, verifying and moving a corpus, and users' own resources."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import corpus, search

MANIFEST = "slug string, name string, source_type string, publisher string, jurisdiction string, source_url string, parser_version string, origin string, model_use_allowed boolean, required_citations array<string>, minimum_documents int"
SECTION = "slug string, content_hash string, document string, document_title string, document_url string, section_key string, citation string, title string, text string, place int"


def manifests(spark, *slugs):
    return spark.createDataFrame([(s, s.upper(), "law" if s == "code" else "guidance", "City", "nyc", f"https://e.org/{s}", "1", "core", True, ["27-2005"] if s == "code" else [], 1) for s in slugs], MANIFEST)


def sections(spark, code="h1", text="Owners provide heat. See MDL 78."):
    rows = [("code", code, "d1", "Code", "u", "s1", "27-2005", "Duties", text, 0), ("code", code, "d1", "Code", "u", "s2", "27-2029", "Heat", "Sixty eight degrees; section 27-2005 applies.", 1), ("guide", "g1", "d", "Guide", "u", "s", None, "Call", "Call 311 about heat.", 0)]
    return spark.createDataFrame(rows, SECTION)


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def test_version_five_uuids(spark):
    names = ["", "corpus:code", "é"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(T.uuid5(F.lit(T.URL_SPACE), F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_install_publish_verify_and_bundle(spark, tmp_path):
    folder, other = f"file://{tmp_path}/corpus", f"file://{tmp_path}/other"
    assert corpus.status(spark, folder)["readiness"] == "not_installed"
    with pytest.raises(ValueError, match="missing:27-2005"):
        corpus.install(spark, folder, manifests(spark, "code"), sections(spark).filter("section_key = 's2'"), at(1), ["code"])
    first = corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark), at(1), ["code", "guide"])
    assert (first["readiness"], first["chunks"], first["is_partial"]) == ("text_ready", 3, False)
    again = corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark), at(2), ["code", "guide"])
    assert again["versions"] == first["versions"] and corpus.read(spark, folder, "chunks").count() == 3
    reflowed = corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark, "h2", "Owners  provide heat. See MDL 78.\n"), at(3), ["code", "guide"])
    assert reflowed["versions"] == first["versions"] and corpus.read(spark, folder, "versions").count() == 2  # other bytes, the same text
    changed = corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark, "h3", "Owners and agents provide heat."), at(4), ["code", "guide"])
    assert changed["versions"]["code"] != first["versions"]["code"] and changed["versions"]["guide"] == first["versions"]["guide"]
    tables = corpus.generation(spark, folder)
    assert corpus.faults(tables).count() == 0 and tables["chunks"].count() == 3
    cited = {(r["normalized_citation"], r["citation_type"]) for r in corpus.generation(spark, folder, first["generation"])["citations"].collect()}
    assert ("NYC Admin Code § 27-2005", "nyc_code") in cited and ("Multiple Dwelling Law § 78", "ny_law") in cited
    corpus.embed(spark, folder, tables["chunks"].select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector")))
    entry = corpus.publish(spark, folder, list(changed["versions"].values()), ["code"])
    assert entry["readiness"] == "hybrid_ready" and all(r["whole"] for r in corpus.verify(spark, folder).collect()) and corpus.verify(spark, folder).count() == 5
    gone = corpus.without_sources(spark, folder, ["guide"], ["code"])
    assert gone["chunks"] == 2 and corpus.removal_preview(spark, folder, ["code", "guide"])["installed"] == ["code"]
    with pytest.raises(ValueError, match="missing: code"):
        corpus.without_sources(spark, folder, ["code"], ["code"])
    assert corpus.with_sources(spark, folder, ["guide"], ["code"])["chunks"] == 3

    manifest = corpus.export_bundle(spark, folder, f"file://{tmp_path}/bundle")
    assert {r["table"]: r["rows"] for r in manifest.collect()}["chunks"] == 3
    moved = corpus.import_bundle(spark, other, f"file://{tmp_path}/bundle", ["code"])
    key = lambda f: sorted(map(tuple, corpus.generation(spark, f)["chunks"].select("chunk_id", "text").collect()))
    assert key(other) == key(folder) and moved["readiness"] == "hybrid_ready"
    assert corpus.import_bundle(spark, other, f"file://{tmp_path}/bundle", ["code"])["chunks"] == 3 and corpus.read(spark, other, "chunks").count() == 3
    rows = spark.read.parquet(f"{other}/chunks").withColumn("text", F.lit("other words"))
    rows.write.parquet(f"file://{tmp_path}/third/chunks")
    with pytest.raises(ValueError, match="contradictions in \\['chunks'\\]"):
        corpus.import_bundle(spark, f"file://{tmp_path}/third", f"file://{tmp_path}/bundle", [])
    spark.range(1).select(F.lit("x").alias("chunk_id")).write.mode("append").parquet(f"file://{tmp_path}/bundle/members")
    with pytest.raises(ValueError, match="was changed: members"):
        corpus.import_bundle(spark, f"file://{tmp_path}/fourth", f"file://{tmp_path}/bundle", [])
    star = search.star(tables["members"], tables["chunks"], tables["modules"], tables["versions"].select("version_id", "content_hash"), tables["documents"].select("document_id", F.col("source_url").alias("url")))
    assert {(r["source"], r["source_type"]) for r in star.collect()} == {("code", "law"), ("guide", "guidance")}


def test_resources(spark, tmp_path):
    folder = f"file://{tmp_path}/corpus"
    corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark), at(1), ["code"])
    parts = spark.createDataFrame([("d", "s1", None, "Notes", "my notes", 0), ("d", "s2", None, "Notes", "more", 1)], "document string, section_key string, citation string, title string, text string, place int")
    added = corpus.add_resource(spark, folder, "user-1", "Notes", parts, "b1", at(5), operation="op-1")
    assert added["status"] == "added" and corpus.add_resource(spark, folder, "user-1", "Notes", parts, "b1", at(6), operation="op-1") == added
    assert corpus.add_resource(spark, folder, "user-2", "Copy", parts, "b1", at(6))["status"] == "duplicate"
    with pytest.raises(ValueError, match="changed meanwhile"):
        corpus.add_resource(spark, folder, "user-1", "Notes", parts, "b2", at(7), replaces="old")
    newer = corpus.add_resource(spark, folder, "user-1", "Notes", parts.filter("place = 0"), "b2", at(7), replaces=added["version_id"])
    edited = corpus.add_resource(spark, folder, "user-1", "My notes", parts.filter("place = 0"), "b2", at(8), replaces=newer["version_id"], metadata="m2")
    assert len({added["version_id"], newer["version_id"], edited["version_id"]}) == 3
    row = corpus.resources(spark, folder).first()
    assert (row["name"], row["active"], row["chunk_count"], row["model_use_allowed"], row["active_version_id"]) == ("My notes", True, 1, False, edited["version_id"])
    assert corpus.status(spark, folder)["chunks"] == 4
    corpus.set_model_use(spark, folder, "user-1", True)
    assert corpus.resources(spark, folder).first()["model_use_allowed"]
    removed = corpus.remove_resource(spark, folder, "user-1", operation="op-2")
    assert corpus.status(spark, folder)["chunks"] == 3 and corpus.remove_resource(spark, folder, "user-1", operation="op-2") == removed
    assert corpus.resources(spark, folder, include_removed=False).count() == 0 and not corpus.resources(spark, folder).first()["active"]
    assert corpus.restore_resource(spark, folder, "user-1")["version_id"] == edited["version_id"]
    assert corpus.restore_resource(spark, folder, "user-1", added["version_id"])["version_id"] == added["version_id"] and corpus.status(spark, folder)["chunks"] == 5
    assert [r["stable_id"] for r in corpus.preview(spark, folder, added["version_id"], 1, "s1").collect()] == ["s2"]
    corpus.export_bundle(spark, folder, f"file://{tmp_path}/bundle")
    assert spark.read.parquet(f"file://{tmp_path}/bundle/modules").filter("origin = 'user'").count() == 0 and spark.read.parquet(f"file://{tmp_path}/bundle/members").count() == 3


def test_indexing_goes_on_and_activates_when_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/corpus"
    corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark), at(1), ["code"])
    vector = T.seed_embedding(F.col("text"), 4)
    before = corpus.status(spark, folder)["generation"]
    part = corpus.index_active(spark, folder, F.when(F.col("text").contains("311"), vector))
    assert part["readiness"] == "hybrid_partial" and corpus.status(spark, folder)["generation"] == before and corpus.to_embed(spark, folder).count() == 2
    whole = corpus.index_active(spark, folder, vector, batches=2)
    assert whole["readiness"] == "hybrid_ready" and corpus.status(spark, folder)["generation"] == whole["generation"] and corpus.to_embed(spark, folder).isEmpty()


def test_records_of_another_store(spark, tmp_path):
    columns = "slug string, name string, source_type string, publisher string, jurisdiction string, source_url string, content_hash string, retrieved_at string, document string, document_title string, document_url string, section_key string, citation string, title string, text string, place int"
    row = lambda h, day, key, text, n: ("code", "Code", "law", "City", "nyc", "u", h, day, "d", "D", "u", key, "27-2005", "T", text, n)
    given, parts = corpus.from_records(spark.createDataFrame([row("h1", "2024-01-01", "s1", "old", 0), row("h2", "2024-01-02", "s1", "new", 0), row("h2", "2024-01-02", "s1", "again", 1), row("h2", "2024-01-02", "s2", "more", 2)], columns))
    assert sorted(r["text"] for r in parts.collect()) == ["more", "new"]
    assert corpus.install(spark, f"file://{tmp_path}/c", given, parts, at(2), ["code"])["chunks"] == 2


def test_texts_stay_where_they_are(spark, tmp_path):
    """Without broadcasts by size, what a generation reaches is read without a shuffle of its texts, also with chunks of another generation beside it."""
    folder = f"file://{tmp_path}/corpus"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus.install(spark, folder, manifests(spark, "code", "guide"), sections(spark), at(1), ["code"])
        first = corpus.status(spark, folder)["generation"]
        extra = spark.read.parquet(f"{folder}/chunks").filter("stable_id = 's1'").withColumn("chunk_id", F.lit("no member"))
        extra.write.mode("append").parquet(f"{folder}/chunks")
        for name, n in ((first, 3), (corpus.with_sources(spark, folder, ["code"], [])["generation"], 4)):
            chunks = corpus.generation(spark, folder, name)["chunks"]
            plan = chunks._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
            assert chunks.count() == n and chunks.columns == extra.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chunks_are_added_by_their_keys(spark, monkeypatch):
    """One row for each new key, whether it comes twice, is known, or neither, and whether the exceptions are broadcast."""
    rows = lambda *keys: spark.createDataFrame([(k, f"text {k}") for k in keys], "chunk_id string, text string")
    for size in (8_000_000, -1):
        monkeypatch.setattr(corpus.relations, "FEW_BYTES", size)
        for new, known, want in (("abc", None, "abc"), ("abcabb", None, "abc"), ("abcc", "ax", "bc"), ("ab", "abz", ""), ("aabb", "ab", ""), ("", "a", ""), ("cab", "z", "abc")):
            got = corpus.new_by_key(rows(*new), None if known is None else rows(*known), "chunk_id").collect()
            assert sorted(map(tuple, got)) == [(k, f"text {k}") for k in want]
        chunks = spark.createDataFrame([(k, v, "t") for k, v in ("a1", "b1", "c2", "d3")], "chunk_id string, version_id string, text string")
        for chosen in ("abcd", "abc", "ac", "d"):
            assert sorted(r["chunk_id"] for r in corpus.of_members(chunks, chunks.filter(F.col("chunk_id").isin(*chosen)).drop("text")).collect()) == list(chosen)


def test_versions_are_hashed_once_and_lines_collapsed_as_before(spark):
    """Chunks are made without adding up their versions' hashes again; lines equal those that Python collapses."""
    import random
    import re

    plan = corpus.stored(manifests(spark, "code", "guide"), sections(spark), at(1))["chunks"]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    ends, rng = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ", random.Random(2)
    white = ends.translate({0x1C: None, 0x1D: None, 0x1E: None}) + "\t \xa0     　"
    texts = ["", " ", "\n", "a\nb c", "a\n\nb", " a", "a\n", "\r\n \r\na", *("".join(rng.choice([*white, *ends, *"ab​\x1f  \n"]) for _ in range(rng.randrange(12))) for _ in range(2000))]
    want = ["\n".join(x for line in re.split(f"[{ends}]", t) if (x := re.sub(f"[{white}]+", " ", line).strip(" "))) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.collapse_lines(F.col("t"))).collect()
    assert [r[1] for r in sorted(rows)] == want
