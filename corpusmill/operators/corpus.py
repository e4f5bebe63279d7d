"""The corpus: sources stored by version, published as snapshots, verified, moved in bundles, and users' own resources.

A corpus is a folder with a table each for modules, versions, documents, chunks, citations, embeddings and the members of
generations. Tables only grow, by rows with ids that follow from their content; a generation is a set of members, and one
entry names the active one. So a reader of an older generation is never disturbed, and a step that runs again adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import citations
from corpusmill.functions.text import URL_SPACE, collapse_lines, uuid5
from corpusmill.operators import relations
from corpusmill.sources import sinks
from corpusmill.sources.shared import file_system, shared_folder

#: Table -> its key.
TABLES = {"modules": "module_id", "versions": "version_id", "documents": "document_id", "chunks": "chunk_id", "citations": "citation_id", "embeddings": "embedding_id"}
SECTIONS = "slug, content_hash, document, document_title, document_url, section_key, citation, title, text, place"


def parsed(branches: dict[str, DataFrame]) -> DataFrame:
    """The sections of all parsers together. ``branches``: parser -> its sections, each with the columns of ``SECTIONS``."""
    columns = SECTIONS.split(", ")
    return reduce(DataFrame.unionByName, (df.select(*columns) for _, df in sorted(branches.items())))


def problems(manifests: DataFrame, sections: DataFrame) -> DataFrame:
    """slug and problems of what was parsed for each manifest: too few documents, no or empty text, law without citation, citations missing."""
    cited = F.array_compact(F.collect_set("citation"))
    found = sections.groupBy("slug").agg(
        F.count_distinct("document").alias("documents"), F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), F.count_if(F.col("citation").isNull()).alias("uncited")
    )
    wanted = manifests.select("slug", F.explode_outer("required_citations").alias("citation")).filter("citation IS NOT NULL")
    absent = wanted.join(sections.select("slug", "citation").distinct(), ["slug", "citation"], "left_anti").groupBy("slug").agg(F.array_sort(cited).alias("absent"))
    rows = manifests.join(found, "slug", "left").join(absent, "slug", "left")
    tests = [
        (F.coalesce("documents", F.lit(0)) < F.col("minimum_documents"), F.lit("too_few_documents")),
        ((F.coalesce("n", F.lit(0)) == 0) | (F.col("empty") > 0), F.lit("empty_content")),
        ((F.col("source_type") == "law") & (F.col("uncited") > 0), F.lit("law_without_citation")),
        (F.size("absent") > 0, F.concat(F.lit("missing:"), F.array_join("absent", ","))),
    ]
    return rows.select("slug", F.array_compact(F.array(*(F.when(test, name) for test, name in tests))).alias("problems"))


def stored(manifests: DataFrame, sections: DataFrame, retrieved_at: Column) -> dict[str, DataFrame]:
    """The rows of each table for what was parsed. Ids follow from slug, content, parser version and section, so equal input gives equal rows.

    ``manifests``: slug, name, source_type, publisher, jurisdiction, source_url, parser_version, origin, model_use_allowed.
    """
    module_id = uuid5(F.lit(URL_SPACE), F.concat(F.lit("corpus:"), F.col("slug")))
    modules = manifests.select(module_id.alias("module_id"), "slug", "name", "source_type", "publisher", "jurisdiction", "source_url", "origin", "model_use_allowed")
    semantic = relations.digests(sections.withColumn("body", collapse_lines(F.col("text"))), "slug", "document", "document_title", "place", "section_key", "citation", "title", "body").withColumnRenamed("digest", "semantic_hash")
    heads = sections.select("slug", "content_hash").distinct().join(manifests.select("slug", "parser_version"), "slug").join(semantic, "slug")
    version_id = uuid5(module_id, F.concat_ws(":", "content_hash", "parser_version"))
    # a row per source, computed once: the tables below would each hash all texts again, and a join with it would move them
    versions = relations.few(heads.select(version_id.alias("version_id"), module_id.alias("module_id"), "slug", "content_hash", "semantic_hash", "parser_version", retrieved_at.alias("retrieved_at")))
    rows = sections.join(versions.select("slug", "content_hash", "version_id", "module_id"), ["slug", "content_hash"])
    rows = rows.withColumn("document_id", uuid5(F.col("version_id"), F.col("document"))).withColumn("chunk_id", F.sha2(F.concat_ws(":", "version_id", "document", "section_key"), 256))
    documents = rows.select("document_id", "version_id", F.col("document").alias("stable_id"), F.col("document_title").alias("title"), F.col("document_url").alias("source_url")).dropDuplicates(["document_id"])
    text_hash = F.sha2(collapse_lines(F.col("text")), 256)
    locator = F.to_json(F.struct(F.coalesce("citation", "section_key").alias("section")))
    chunks = rows.select("chunk_id", "document_id", "module_id", "version_id", F.col("section_key").alias("stable_id"), "citation", "title", "text", text_hash.alias("text_hash"), locator.alias("locator_json"))
    return {"modules": modules, "versions": versions, "documents": documents, "chunks": chunks, "citations": section_citations(chunks)}


def section_citations(chunks: DataFrame) -> DataFrame:
    """citation_id, chunk_id, normalized_citation, display_citation, citation_type: a section's own citation and those in its text, each form once."""
    own = chunks.filter(F.col("citation").isNotNull()).select("chunk_id", F.lit(-1).alias("ordinal"), F.col("citation").alias("display_citation"), citations.normalize(F.col("citation")).alias("normalized_citation"))
    found = citations.extract(chunks, "text", "chunk_id").select("chunk_id", "ordinal", F.trim("citation_text").alias("display_citation"), "normalized_citation")
    each = own.unionByName(found).groupBy("chunk_id", "normalized_citation").agg(F.min_by("display_citation", "ordinal").alias("display_citation"))
    return each.select(F.sha2(F.concat_ws(":", "chunk_id", "normalized_citation"), 256).alias("citation_id"), "chunk_id", "normalized_citation", "display_citation", citations.citation_type(F.col("normalized_citation")).alias("citation_type"))


def same_content(new: DataFrame, known: DataFrame) -> DataFrame:
    """version_id of each new version and kept_id: itself, or the known one of its module and parser that says the same."""
    prior = known.groupBy("module_id", "parser_version", "semantic_hash").agg(F.min_by("version_id", "retrieved_at").alias("_prior"))
    return new.join(prior, ["module_id", "parser_version", "semantic_hash"], "left").select("version_id", "slug", F.coalesce("_prior", "version_id").alias("kept_id"))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the corpus, or None before its first rows. Of modules, the row that was written last counts."""
    fs, to_path = file_system(spark, folder)
    if not fs.exists(to_path(f"{folder}/{name}")):
        return None
    rows = spark.read.parquet(f"{folder}/{name}")
    return relations.latest_per_key(rows, ["module_id"], [F.desc("_written")]).drop("_written") if name == "modules" else rows


def _append(folder: str, name: str, rows: DataFrame) -> None:
    """Adds the rows whose key is new; modules are added as they are, since their metadata may change."""
    spark, key = rows.sparkSession, TABLES[name]
    if name == "modules":
        rows.withColumn("_written", F.current_timestamp()).write.mode("append").parquet(f"{folder}/{name}")
        return
    known = read(spark, folder, name)
    if name == "chunks":
        rows = new_by_key(rows, known, key)
    else:
        rows = (rows if known is None else rows.join(known.select(key), key, "left_anti")).dropDuplicates([key])
    rows.write.mode("append").parquet(f"{folder}/{name}")


def new_by_key(rows: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """One row for each key that ``known`` lacks. Keys alone are compared, so texts move only for keys that come twice or are known in part."""
    keys = rows.groupBy(key).agg(F.count("*").alias("_n"))
    here = keys.withColumn("_known", F.lit(None).cast("boolean")) if known is None else keys.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    shared_folder(rows.sparkSession)
    odd = here.filter("_known OR _n > 1").checkpoint()
    n, twice, size = odd.agg(F.count("*"), F.count_if(F.col("_known").isNull()), F.sum(F.octet_length(key))).first()
    if not n:
        return rows
    if not twice and keys.count() == n:
        return rows.limit(0)
    mark = lambda df: F.broadcast(df) if (size or 0) <= relations.FEW_BYTES else df
    plain = rows.join(mark(odd.select(key)), key, "left_anti")
    return plain if not twice else plain.unionByName(rows.join(mark(odd.filter("_known IS NULL").select(key)), key, "left_semi").dropDuplicates([key]))


def of_members(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """The chunks that are members. Ids alone are compared: where all chunks of the members' versions are members, no text moves."""
    versions = relations.few(members.select("version_id").distinct())
    near = chunks.join(versions, "version_id", "left_semi").select(*chunks.columns)
    shared_folder(chunks.sparkSession)
    others = near.select("chunk_id").join(members.select("chunk_id"), "chunk_id", "left_anti").checkpoint()
    size = others.agg(F.sum(F.octet_length("chunk_id"))).first()[0]
    if size is None:
        return near
    if size <= relations.FEW_BYTES:
        return near.join(F.broadcast(others), "chunk_id", "left_anti").select(*chunks.columns)
    return near.join(members.select("chunk_id"), "chunk_id", "left_semi").select(*chunks.columns)


def members(chunks: DataFrame, modules: DataFrame, versions: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """chunk_id, version_id, text_ready, embedding_ready and eligible of the chunks of chosen versions."""
    chosen, allowed = relations.few(versions.select("version_id")), relations.few(modules.select("module_id", "model_use_allowed"))
    rows = chunks.select("chunk_id", "version_id", "module_id").join(chosen, "version_id", "left_semi").join(allowed, "module_id")
    ready = rows.withColumn("_e", F.lit(None).cast("boolean")) if embeddings is None else rows.join(embeddings.select("chunk_id").distinct().withColumn("_e", F.lit(True)), "chunk_id", "left")
    eligible = F.coalesce("model_use_allowed", F.lit(False))
    return ready.select("chunk_id", "version_id", F.lit(True).alias("text_ready"), (eligible & F.coalesce("_e", F.lit(False))).alias("embedding_ready"), eligible.alias("eligible"))


def publish(spark: SparkSession, folder: str, versions: list[str], required: list[str], allow_partial: bool = False, activate: bool = True) -> dict:
    """Writes a generation of the versions and makes it active. An error if a required source is missing or a version unknown."""
    known = read(spark, folder, "versions")
    chosen = known.filter(F.col("version_id").isin(versions)) if known is not None else None
    found = {r["version_id"]: r["slug"] for r in chosen.select("version_id", "slug").collect()} if chosen is not None else {}
    unknown, missing = sorted(set(versions) - set(found)), sorted(set(required) - set(found.values()))
    if unknown:
        raise ValueError(f"Unknown source versions: {', '.join(unknown)}")
    if missing and not allow_partial:
        raise ValueError(f"Sources are missing: {', '.join(missing)}")
    rows = members(read(spark, folder, "chunks"), read(spark, folder, "modules"), chosen, read(spark, folder, "embeddings"))
    generation = sinks.publish(rows, f"{folder}/members", activate=False)
    counts = spark.read.parquet(f"{folder}/members/generations/{generation}").agg(F.count("*").alias("chunks"), F.count_if("eligible").alias("eligible"), F.count_if("embedding_ready").alias("ready")).first()
    readiness = ("hybrid_ready" if counts["ready"] == counts["eligible"] else "hybrid_partial") if counts["ready"] else "partial_text_ready" if missing else "text_ready"
    entry = {"generation": generation, "versions": dict(sorted((slug, v) for v, slug in found.items())), "readiness": readiness, "is_partial": bool(missing), "missing": missing, "chunks": counts["chunks"], "ready": counts["ready"]}
    sinks.commit(spark, f"{folder}/generations", entry)
    if activate:
        sinks.commit(spark, f"{folder}/active", entry)
    return entry


def status(spark: SparkSession, folder: str) -> dict:
    """What is active: readiness, sources and counts."""
    return sinks.latest(spark, f"{folder}/active") or {"generation": None, "readiness": "not_installed", "is_partial": False, "versions": {}, "chunks": 0, "ready": 0}


def install(spark: SparkSession, folder: str, manifests: DataFrame, sections: DataFrame, retrieved_at: Column, required: list[str], allow_partial: bool = False) -> dict:
    """Checks, stores and publishes what was parsed, beside the sources that are active already. Nothing is stored if a check fails."""
    failed = {r["slug"]: r["problems"] for r in problems(manifests, sections).filter("size(problems) > 0").collect()}
    if failed:
        raise ValueError(f"Sources were refused: {failed}")
    tables = stored(manifests, sections, retrieved_at)
    known = read(spark, folder, "versions")
    kept = tables["versions"].select("version_id", "slug", F.col("version_id").alias("kept_id")) if known is None else same_content(tables["versions"], known)
    kept = {r["slug"]: (r["version_id"], r["kept_id"]) for r in kept.collect()}  # a row per source of this installation
    reused = [v for v, k in kept.values() if v != k]
    for name, rows in tables.items():
        if "version_id" in rows.columns and reused:
            rows = rows.filter(~F.col("version_id").isin(reused))
        elif name == "citations" and reused:
            rows = section_citations(tables["chunks"].filter(~F.col("version_id").isin(reused)))
        _append(folder, name, rows)
    versions = status(spark, folder)["versions"] | {slug: k for slug, (_, k) in kept.items()}
    return publish(spark, folder, list(versions.values()), required, allow_partial)


def embed(spark: SparkSession, folder: str, vectors: DataFrame) -> None:
    """Stores the vectors (chunk_id, vector) of chunks that have none yet."""
    _append(folder, "embeddings", vectors.select(F.sha2("chunk_id", 256).alias("embedding_id"), "chunk_id", "vector"))


def to_embed(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id and text of what is active, may be used by models and has no vector yet."""
    found = generation(spark, folder)
    eligible = found["chunks"].join(found["members"].filter("eligible").select("chunk_id"), "chunk_id", "left_semi")
    return eligible.select("chunk_id", "text") if "embeddings" not in found else eligible.join(found["embeddings"].select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "text")


def index_active(spark: SparkSession, folder: str, vector: Column, batches: int = 1) -> dict:
    """Embeds what lacks a vector, in batches that are each kept, and then publishes the active versions again.

    A run that stops goes on with what is left. The new generation becomes active only if every eligible chunk has its
    vector. ``vector``: an expression over the column text.
    """
    missing = to_embed(spark, folder)
    for b in range(batches):
        part = missing.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(batches)) == b)
        embed(spark, folder, part.select("chunk_id", vector.alias("vector")).filter("vector IS NOT NULL"))
    whole = to_embed(spark, folder).isEmpty()
    return publish(spark, folder, list(status(spark, folder)["versions"].values()), [], allow_partial=True, activate=whole)


def without_sources(spark: SparkSession, folder: str, slugs: list[str], required: list[str]) -> dict:
    """Publishes what is active without some sources; required ones can't go."""
    now = status(spark, folder)["versions"]
    return publish(spark, folder, [v for s, v in now.items() if s not in slugs], required)


def with_sources(spark: SparkSession, folder: str, slugs: list[str], required: list[str]) -> dict:
    """Publishes what is active with the newest stored version of some sources."""
    known = read(spark, folder, "versions").filter(F.col("slug").isin(slugs))
    newest = relations.latest_per_key(known, ["slug"], [F.desc("retrieved_at"), F.desc("version_id")])
    found = {r["slug"]: r["version_id"] for r in newest.select("slug", "version_id").collect()}
    return publish(spark, folder, list((status(spark, folder)["versions"] | found).values()), required, allow_partial=True)


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests and sections of another store's current records, one row per chunk: of each source the newest version, citations once.

    ``records``: slug, name, source_type, publisher, jurisdiction, source_url, content_hash, retrieved_at, document,
    document_title, document_url, section_key, citation, title, text, place.
    """
    newest = relations.latest_per_key(records.select("slug", "content_hash", "retrieved_at").distinct(), ["slug"], [F.desc("retrieved_at"), F.desc("content_hash")])
    rows = records.join(newest.select("slug", "content_hash"), ["slug", "content_hash"], "left_semi")
    first = rows.groupBy("slug").agg(*(F.min(c).alias(c) for c in ("name", "source_type", "publisher", "jurisdiction", "source_url")))
    manifests = first.select("*", F.lit("migrated").alias("parser_version"), F.lit("core").alias("origin"), F.lit(True).alias("model_use_allowed"), F.array().cast("array<string>").alias("required_citations"), F.lit(0).alias("minimum_documents"))
    return manifests, relations.latest_per_key(rows, ["slug", "document", "section_key"], [F.asc("place")]).select(*SECTIONS.split(", "))


def removal_preview(spark: SparkSession, folder: str, pack: list[str], selected: list[str] | None = None) -> dict:
    """Which of a pack's modules, or of those selected, are installed and would go."""
    chosen = list(dict.fromkeys(pack if selected is None else selected))
    if not chosen or set(chosen) - set(pack):
        raise ValueError("Select modules of the pack.")
    there = status(spark, folder)["versions"]
    gone = [s for s in chosen if s in there]
    return {"selected": chosen, "installed": gone, "retained": bool(gone)}


def generation(spark: SparkSession, folder: str, name: str | None = None) -> dict[str, DataFrame]:
    """The rows of every table that a generation, the active one if none is named, reaches."""
    name = name or status(spark, folder)["generation"]
    rows = {"members": spark.read.parquet(f"{folder}/members/generations/{name}")}
    rows["chunks"] = of_members(read(spark, folder, "chunks"), rows["members"])
    for child, parent, key in (("versions", "chunks", "version_id"), ("modules", "versions", "module_id"), ("documents", "chunks", "document_id"), ("citations", "chunks", "chunk_id"), ("embeddings", "chunks", "chunk_id")):
        table = read(spark, folder, child)
        if table is not None:
            reached = rows[parent].select(key).distinct()
            rows[child] = table.join(relations.few(reached) if child in ("versions", "modules") else reached, key, "left_semi")
    return rows


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """fault and n, for the faults there are: rows whose parent is missing, changed texts, members that aren't there, users' own modules."""
    checks = {
        "version_without_module": relations.broken_references(tables["versions"].select("module_id"), tables["modules"], "module_id"),
        "document_without_version": relations.broken_references(tables["documents"].select("version_id"), tables["versions"], "version_id"),
        "chunk_without_document": relations.broken_references(tables["chunks"].select("document_id"), tables["documents"], "document_id"),
        "citation_without_chunk": relations.broken_references(tables["citations"].select("chunk_id"), tables["chunks"], "chunk_id"),
        "member_without_chunk": relations.broken_references(tables["members"].select("chunk_id"), tables["chunks"], "chunk_id"),
        "changed_text": tables["chunks"].filter(F.sha2(collapse_lines(F.col("text")), 256) != F.col("text_hash")),
        "own_resource": tables["modules"].filter("origin = 'user'"),
    }
    if "embeddings" in tables:
        checks["embedding_without_chunk"] = relations.broken_references(tables["embeddings"].select("chunk_id"), tables["chunks"], "chunk_id")
    counts = (df.agg(F.lit(name).alias("fault"), F.count("*").alias("n")) for name, df in checks.items())
    return reduce(DataFrame.unionByName, counts).filter("n > 0")


def verify(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """A row per generation that was ever published: chunks, those stored, ready and indexed, and whether it is whole."""
    names = [e["generation"] for e in (sinks._entry(spark, f"{folder}/generations", n) for n in sinks._entry_names(spark, f"{folder}/generations")) if e]
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(f"{folder}/members/generations/{n}").withColumn("generation", F.lit(n)) for n in dict.fromkeys(names)))
    rows = rows.join(read(spark, folder, "chunks").select("chunk_id", F.lit(1).alias("_s")), "chunk_id", "left")
    rows = rows.withColumn("_i", F.col("_s")) if index is None else rows.join(index.select("chunk_id").distinct().withColumn("_i", F.lit(1)), "chunk_id", "left")
    counted = rows.groupBy("generation").agg(F.count("*").alias("chunks"), F.count("_s").alias("stored"), F.count("_i").alias("indexed"), F.count_if("embedding_ready").alias("embedded"), F.count_if("eligible").alias("eligible"))
    return counted.withColumn("whole", (F.col("chunks") == F.col("stored")) & (F.col("chunks") == F.col("indexed")))


def export_bundle(spark: SparkSession, folder: str, to: str, name: str | None = None) -> DataFrame:
    """Writes a generation as a bundle: a folder per table and a manifest with rows and digests. Users' own resources stay here."""
    name = name or status(spark, folder)["generation"]
    tables = generation(spark, folder, name)
    public = tables["modules"].filter("origin <> 'user'")
    versions = tables["versions"].join(public.select("module_id"), "module_id", "left_semi")
    chunks = tables["chunks"].join(relations.few(versions.select("version_id")), "version_id", "left_semi")
    kept = tables | {"modules": public, "versions": versions, "chunks": chunks} | {n: tables[n].join(chunks.select(k).distinct(), k, "left_semi") for n, k in (("documents", "document_id"), ("citations", "chunk_id"), ("members", "chunk_id"), ("embeddings", "chunk_id")) if n in tables}
    return sinks.back_up(kept, to)


def import_bundle(spark: SparkSession, folder: str, bundle: str, required: list[str]) -> dict:
    """Adds a bundle's rows and publishes its versions. An error if the bundle was changed, is at fault, or contradicts rows that are here."""
    tables = sinks.restored_backup(spark, bundle)
    found = [r["fault"] for r in faults(tables).collect()]
    clashing = []
    for name, key in TABLES.items():
        known = read(spark, folder, name) if name in tables else None
        if known is not None and not relations.conflicts(known.select(*tables[name].columns), tables[name], key).isEmpty():
            clashing.append(name)
    if found or clashing:
        raise ValueError(f"The bundle is refused: faults {found}, contradictions in {clashing}")
    for name in TABLES:
        if name in tables:
            _append(folder, name, tables[name] if name != "modules" or read(spark, folder, name) is None else tables[name].join(read(spark, folder, name).select("module_id"), "module_id", "left_anti"))
    versions = [r["version_id"] for r in tables["versions"].select("version_id").collect()]
    return publish(spark, folder, versions, required, allow_partial=True)


# --- users' own resources


def receipt(spark: SparkSession, folder: str, operation: str) -> dict | None:
    """What an operation with this id gave when it ran before."""
    names = sinks._entry_names(spark, f"{folder}/receipts/{operation}")
    return sinks._entry(spark, f"{folder}/receipts/{operation}", names[0]) if names else None


def _once(spark: SparkSession, folder: str, operation: str | None, run) -> dict:
    """Runs an operation unless its id has a receipt already."""
    done = receipt(spark, folder, operation) if operation else None
    result = done or run()
    if operation and not done:
        sinks.commit(spark, f"{folder}/receipts/{operation}", result)
    return result


def add_resource(spark: SparkSession, folder: str, slug: str, name: str, sections: DataFrame, content_hash: str, retrieved_at: Column, operation: str | None = None, replaces: str | None = None, metadata: str = "", model_use: bool = False) -> dict:
    """Stores a user's file as a module of its own and publishes it. The same bytes again are a duplicate and add nothing.

    With ``replaces``, the version that is active must be that one: a change made from an older state is refused. New
    metadata makes a new version of the same bytes. ``sections``: document, section_key, citation, title, text, place.
    """

    def run() -> dict:
        now, known = status(spark, folder), read(spark, folder, "versions")
        if replaces is not None and now["versions"].get(slug) != replaces:
            raise ValueError("The resource was changed meanwhile.")
        if replaces is None and known is not None:
            twin = relations.latest_per_key(known.filter(F.col("content_hash") == content_hash), ["content_hash"], [F.desc("retrieved_at"), F.desc("version_id")]).first()
            if twin:
                return {"status": "duplicate", "slug": twin["slug"], "version_id": twin["version_id"], "generation": now["generation"]}
        one = spark.range(1).select(
            F.lit(slug).alias("slug"), F.lit(name).alias("name"), F.lit("resource").alias("source_type"), F.lit("").alias("publisher"), F.lit("").alias("jurisdiction"), F.lit(None).cast("string").alias("source_url"),
            F.lit(f"resource-{metadata}").alias("parser_version"), F.lit("user").alias("origin"), F.lit(model_use).alias("model_use_allowed"),
        )
        whole = sections.withColumns({"slug": F.lit(slug), "content_hash": F.lit(content_hash), "document_title": F.lit(name), "document_url": F.lit(None).cast("string")})
        tables = stored(one, whole, retrieved_at)
        for table, rows in tables.items():
            _append(folder, table, rows)
        version = tables["versions"].first()["version_id"]
        entry = publish(spark, folder, list((now["versions"] | {slug: version}).values()), [], allow_partial=True)
        return {"status": "replaced" if replaces else "added", "slug": slug, "version_id": version, "generation": entry["generation"]}

    return _once(spark, folder, operation, run)


def remove_resource(spark: SparkSession, folder: str, slug: str, operation: str | None = None) -> dict:
    """Publishes what is active without the resource; its versions stay stored."""
    return _once(spark, folder, operation, lambda: {"status": "removed", "slug": slug, "generation": without_sources(spark, folder, [slug], [])["generation"]})


def restore_resource(spark: SparkSession, folder: str, slug: str, version: str | None = None, operation: str | None = None) -> dict:
    """Publishes a stored version of the resource again, the newest if none is named."""

    def run() -> dict:
        if version is None:
            entry = with_sources(spark, folder, [slug], [])
        else:
            entry = publish(spark, folder, list((status(spark, folder)["versions"] | {slug: version}).values()), [], allow_partial=True)
        return {"status": "restored", "slug": slug, "version_id": entry["versions"][slug], "generation": entry["generation"]}

    return _once(spark, folder, operation, run)


def set_model_use(spark: SparkSession, folder: str, slug: str, allowed: bool, operation: str | None = None) -> dict:
    """Changes whether models may use a source, and publishes anew if it is active."""

    def run() -> dict:
        now = status(spark, folder)
        _append(folder, "modules", read(spark, folder, "modules").filter(F.col("slug") == slug).withColumn("model_use_allowed", F.lit(allowed)))
        entry = publish(spark, folder, list(now["versions"].values()), [], allow_partial=True) if slug in now["versions"] else now
        return {"status": "model_use_updated", "slug": slug, "generation": entry["generation"]}

    return _once(spark, folder, operation, run)


def resources(spark: SparkSession, folder: str, include_removed: bool = True) -> DataFrame:
    """Users' resources: slug, name, model_use_allowed, active, active_version_id, latest_version_id, added_at, chunk_count of the version shown."""
    now = [F.struct(F.lit(s).alias("slug"), F.lit(v).alias("active_version_id")) for s, v in status(spark, folder)["versions"].items()]
    active = spark.range(1).select(F.inline(F.array(*now))) if now else spark.createDataFrame([], "slug string, active_version_id string")
    latest = relations.latest_per_key(read(spark, folder, "versions"), ["slug"], [F.desc("retrieved_at"), F.desc("version_id")]).select("slug", F.col("version_id").alias("latest_version_id"), F.col("retrieved_at").alias("added_at"))
    counts = read(spark, folder, "chunks").groupBy("version_id").agg(F.count("*").alias("chunk_count"))
    rows = read(spark, folder, "modules").filter("origin = 'user'").select("slug", "name", "model_use_allowed").join(latest, "slug", "left").join(active, "slug", "left")
    shown = rows.withColumn("version_id", F.coalesce("active_version_id", "latest_version_id")).join(counts, "version_id", "left").drop("version_id")
    listed = shown.withColumns({"active": F.col("active_version_id").isNotNull(), "chunk_count": F.coalesce("chunk_count", F.lit(0))})
    return listed if include_removed else listed.filter("active")


def preview(spark: SparkSession, folder: str, version: str, limit: int, after: str = "") -> DataFrame:
    """The first chunks of a version, by their id, after one that was shown."""
    return read(spark, folder, "chunks").filter((F.col("version_id") == version) & (F.col("stable_id") > after)).orderBy("stable_id").limit(limit).select("chunk_id", "stable_id", "title", "text", "locator_json")
