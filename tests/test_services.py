"""Operators on matters, caches, feeds and back-ups that no query covers, and queries without SQL against plain versions."""

import datetime as dt
import difflib
import re
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill import plans
from corpusmill.operators import audit, ledger, matters, property, relations
from corpusmill.sources import feeds, sinks, tables
from corpusmill.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the data folder isn't here")
def now():
    return F.lit("2024-05-01").cast("timestamp_ntz")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_matters(spark):
    none = spark.createDataFrame([], "matter_id string, title string, description string, tags array<string>, archived boolean, revision long, updated_at timestamp_ntz")
    new = spark.createDataFrame([("m1", " Heat ", None, ["Rent", "rent", "Heat"]), ("m2", " ", "x", None), ("m3", "Gas", "leak", None)], "matter_id string, title string, description string, tags array<string>")
    made = matters.created(none, new, now())
    assert sorted((r["matter_id"], r["title"], r["description"], tuple(r["tags"]), r["revision"]) for r in made.collect()) == [("m1", "Heat", "", ("Rent", "Heat"), 1), ("m3", "Gas", "leak", (), 1)]
    assert matters.created(made, new, now()).count() == 2
    changed = matters.updated(made, made.select("matter_id", F.lit("New").alias("title"), F.when(F.col("matter_id") == "m1", 1).otherwise(7).cast("long").alias("revision")))
    assert sorted((r["matter_id"], r["title"], r["revision"]) for r in changed.collect()) == [("m1", "New", 2), ("m3", "Gas", 1)]

    items, receipts = spark.createDataFrame([("i0", "p")], "item_id string, payload string"), spark.createDataFrame([("k0", "i0")], "save_key string, item_id string")
    items, receipts = matters.saved(items, spark.createDataFrame([("i1", "a", "k1"), ("i2", "b", "k1"), ("i3", "c", "k0")], "item_id string, payload string, save_key string"), receipts)
    assert rows(items) == [("i0", "p"), ("i1", "a")] and rows(receipts) == [("k0", "i0"), ("k1", "i1")]
    links = spark.createDataFrame([("m1", "i0", 1), ("m3", "i0", 1), ("m1", "i1", 2)], "matter_id string, item_id string, display_order long")
    asked = spark.createDataFrame([("i0", "m1"), ("i1", None)], "item_id string, matter_id string")
    assert rows(matters.deletion_preview(links, asked)) == [("i0", ["m1"], ["m3"], False), ("i1", ["m1"], [], True)]
    left = matters.deleted(items, links, receipts, asked)
    assert [rows(df.select(sorted(df.columns))) for df in left] == [[("i0", "p")], [(1, "i0", "m3")], [("i0", "k0")]]
    notes = spark.createDataFrame([("n1", "m1", None, "boiler note", 1), ("n2", None, "i0", "through item", 1), ("n3", None, "zz", "nowhere", 1)], "note_id string, matter_id string, item_id string, body string, revision long")
    assert rows(matters.notes_of(notes, links).select("matter_id", "note_id")) == [("m1", "n1"), ("m1", "n2"), ("m3", "n2")]
    put = matters.put_notes(notes, spark.createDataFrame([("n1", "m1", None, "new", 1), ("n2", None, "i0", "late", 9), ("n9", "m3", None, "first", 0)], notes.schema))
    assert sorted((r["note_id"], r["body"], r["revision"]) for r in put.collect()) == [("n1", "new", 2), ("n2", "through item", 1), ("n3", "nowhere", 1), ("n9", "first", 1)]
    assert rows(matters.summaries(made, links).select("matter_id", "item_count")) == [("m1", 2), ("m3", 1)]
    bodies = matters.notes_of(notes, links).groupBy("matter_id").agg(F.array_join(F.collect_list("body"), " ").alias("body"))
    assert [r["matter_id"] for r in matters.matching(made, bodies, ["Boiler", "heat"]).collect()] == ["m1"]
    out = matters.exported(made, items, links, notes).collect()
    assert {r["member"] for r in out if r["matter_id"] == "m3"} == {"matter/m3", "item/i0", "note/n2"} and all(len(r["checksum"]) == 64 for r in out)
    log = spark.createDataFrame([], "rule_ids array<string>, topic string, helpful boolean, created_at timestamp_ntz")
    assert matters.feedback(log, spark.createDataFrame([(["a", "x"], "t", True)], "rule_ids array<string>, topic string, helpful boolean"), ["a"], now()).first()["rule_ids"] == ["a"]


def test_dossiers(spark):
    known = spark.createDataFrame([("1|MAIN||", "7"), ("2|MAIN||", "8"), ("3|MAIN||", "9")], "normalized_address string, building_id string")
    records = spark.createDataFrame([("1|MAIN||", "7", 100), ("1|MAIN||", "7", 101), ("2|MAIN||", "99", 102)], "normalized_address string, building_id string, violation_id long")
    got = {r["normalized_address"]: r for r in matters.observations(known, records, ["hpd_violations", "permits"], now()).collect()}
    import json

    payload = json.loads(got["1|MAIN||"]["payload"])
    assert [r["violation_id"] for r in payload["hpd_violations"]["records"]] == [100, 101] and payload["permits"] == {"status": "unavailable"}
    assert got["2|MAIN||"]["status"] == "mismatch" and got["2|MAIN||"]["payload"] is None and got["3|MAIN||"]["records"] == 0


def test_caches_and_floors(spark):
    cache = spark.createDataFrame([("a", True, 1), ("b", False, 2)], "cache_key string, pinned boolean, size_bytes long").withColumn("last_accessed", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("expires_at", F.lit("2024-04-30").cast("timestamp_ntz"))
    keys = spark.createDataFrame([("b",)], "cache_key string")
    hits, touched = ledger.cache_read(cache, keys, now())
    assert hits.first()["state"] == "stale" and sorted((r["cache_key"], r["last_accessed"].month) for r in touched.collect()) == [("a", 1), ("b", 5)]
    assert [r["cache_key"] for r in ledger.cache_clear(cache).collect()] == ["a"] and ledger.cache_pin(cache, keys, True).filter("pinned").count() == 2
    floors = spark.createDataFrame([("2024-03", "2024-02", 5), ("2024-01", "2024-02", 5), ("2024-01", "2024-02", 0), (None, "2024-02", 1)], "p string, c string, n int")
    assert [r[0] for r in floors.select(ledger.pruned_floor(F.col("p"), F.col("c"), F.col("n"))).collect()] == ["2024-03", "2024-02", "2024-01", "2024-02"]


def test_audits(spark):
    chunks = spark.createDataFrame([("a", "law", None, "t"), ("a", "law", "c", "t"), ("b", "guidance", None, "Full Text")], "source string, source_type string, citation string, title string")
    versions = spark.createDataFrame([("v1", "x", None), ("v2", "y", None), ("v3", "z", "2024")], "version_id string, artifact string, purged_at string")
    assert tuple(audit.traceability(chunks, versions, spark.createDataFrame([("x",)], "artifact string")).first()) == (3, 1, 1, 3, 1, 1)
    assert rows(audit.whole_page_chunks(chunks, "source")) == [("a", 0), ("b", 1)] and audit.any_in_scope(chunks, F.col("source") == "b") and not audit.any_in_scope(chunks, F.lit(False))
    assert tuple(audit.size_and_count(spark.range(3), "id").first()) == (3, 3) and tuple(audit.size_and_count(spark.range(0), "id").first()) == (0, 0)
    old = spark.createDataFrame([("s", "v1", False, 3), ("s", "v2", True, 1), ("t", "v3", False, 1), ("t", "v4", False, 2)], "s string, version_id string, is_current boolean, retrieved_at int")
    assert rows(audit.current_version(old, "s").select("s", "version_id")) == [("s", "v2"), ("t", "v4")]
    parts = spark.createDataFrame([("26-501", "a", 0), ("26-501", "longer", 1), ("26-520.1", "x", 2), ("26-520", "y", 3), ("26-501.2", "z", 4), (None, "n", 5), ("27-510", "w", 6)], "citation string, text string, place int")
    assert [tuple(r)[:2] for r in audit.range_sections(parts, "26-501", "26-520").collect()] == [("26-501", "longer"), ("26-501.2", "z"), ("26-520", "y")]
    maps = spark.range(1).select(audit.override(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9))).alias("m")).first()["m"]
    assert maps == {"a": 1, "b": 9} and audit.distinct_paths([(chunks, "source"), (versions, "artifact"), (chunks, "citation")]).count() == 6
    cited = spark.createDataFrame([("q", "c1"), ("q", "c2"), ("q", "zz")], "q string, chunk_id string")
    assert audit.source_types(cited, spark.createDataFrame([("c1", "law"), ("c2", "guide")], "chunk_id string, source_type string"), "q").first()["source_types"] == ["guide", "law"]


def test_backups_leave_private_tables_out_and_notice_changes(spark, tmp_path):
    out = f"file://{tmp_path}/backup"
    tables = {"a": spark.range(5), "secret": spark.range(3), "user": spark.createDataFrame([(1, "k")], "id int, token string")}
    sinks.back_up(tables, out, {"secret": [], "user": ["token"]})
    back = sinks.restored_backup(spark, out)
    assert back["a"].count() == 5 and back["secret"].count() == 0 and back["user"].columns == ["id"]
    spark.range(9).write.mode("append").parquet(f"{out}/a")
    with pytest.raises(ValueError, match="changed: a"):
        sinks.restored_backup(spark, out)
    sinks.export_markdown(spark.createDataFrame([(1, "A\nb", "x"), (2, None, None)], "id int, t string, x string").coalesce(1), f"file://{tmp_path}/md", "t", "x", "id")
    assert "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*"))).startswith("## A b\n\nx\n")


def test_readers_and_exports(spark, tmp_path):
    import csv
    import json

    (tmp_path / "m.json").write_text(json.dumps([{"slug": "a", "required_citations": ["x"], "other": 1}, {"slug": "b"}]))
    assert sorted((r["slug"], r["minimum_documents"], tuple(r["required_citations"])) for r in tables.manifests(spark, f"file://{tmp_path}/m.json").collect()) == [("a", 1, ("x",)), ("b", 1, ())]
    good = [{"id": str(i), "query": "q", "expected_citations": ["c"]} for i in range(2)] + [{"id": "e", "query": "q", "expected_empty": True}]
    for name, cases, ok in (("good", good, True), ("few", good[:1], False), ("twice", [*good, good[0]], False), ("bare", [*good, {"id": "z", "query": "q"}], False)):
        (tmp_path / f"{name}.json").write_text(json.dumps(cases))
        if ok:
            assert tables.cases(spark, f"file://{tmp_path}/{name}.json", 2).count() == 3
        else:
            with pytest.raises(ValueError, match="refused"):
                tables.cases(spark, f"file://{tmp_path}/{name}.json", 2)
    records = spark.createDataFrame([("1", "=2", None)], "violation_id string, description string, borough string").coalesce(1)
    sinks.export_properties(records, f"file://{tmp_path}/csv", {"dataset_id": "d", "stale": False, "total_count": None})
    (row,) = csv.DictReader(next((tmp_path / "csv" / "rows").glob("part-*")).open())
    assert len(row) == 27 and (row["export_version"], row["dataset_id"], row["stale"], row["total_count"], row["description"], row["borough"]) == ("2", "d", "false", "", "'=2", "")
    log = f"file://{tmp_path}/log"
    sinks.append_log(spark.createDataFrame([(1, "a"), (1, "a")], "id int, q string"), log, "id")
    assert rows(sinks.append_log(spark.createDataFrame([(1, "b"), (2, "c")], "id int, q string"), log, "id")) == [(1, "a"), (2, "c")]


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    for i in range(3):
        sinks.publish(spark.range(i + 1), folder)
    assert len(sinks.history(spark, folder)) == 3 and sinks.active(spark, folder).count() == 3
    sinks.roll_back(spark, folder)
    assert sinks.active(spark, folder).count() == 2
    with pytest.raises(Exception):  # noqa: B017  a number that is taken
        sinks._write_text(spark, f"{folder}/{sinks.POINTERS}/{4:012d}", "{}", overwrite=False)
    (tmp_path / "t" / sinks.POINTERS / f"{9:012d}").write_text('{"gener')  # a writer that died
    assert sinks.active(spark, folder).count() == 2


def test_numbered_places(spark):
    values = [(i, (i * 7919) % 101 if i % 9 else None) for i in range(1000)]
    df = spark.createDataFrame(values, "id int, v int").repartition(6)
    got = {r["id"]: r["n"] for r in relations.numbered(df, [F.desc_nulls_last("v"), F.asc("id")], "n").collect()}
    order = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[i] for i, _ in order] == list(range(1, 1001)) and relations.numbered(df.limit(0), [F.asc("id")], "n").count() == 0


def feed_files(folder, rows, number):
    """A feed's rows as one more Parquet file of two row groups."""
    Path(folder).mkdir(exist_ok=True)
    columns = zip(*rows, strict=True)
    table = pa.table({n: pa.array(c, k) for (n, k), c in zip((("violation_id", pa.string()), ("status_date", pa.timestamp("us")), ("status", pa.string())), columns, strict=True)})
    pq.write_table(table, f"{folder}/part-{number}.parquet", row_group_size=max(1, len(rows) // 2))


def test_ingest_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    assert ingest.run_mode("auto", None) == ("full", False, None) and ingest.run_mode("delta", {"complete": True}) == ("full", False, None)
    assert ingest.run_mode("auto", {"complete": True, "mode": "full", "watermark": "2024-03-20"}) == ("delta", False, "2024-03-06")
    assert ingest.run_mode("delta", {"complete": False, "mode": "delta", "watermark": "2024-03-20"}) == ("delta", True, None)
    with pytest.raises(ValueError):
        ingest.run_mode("other", None)
    start, path, folder = dt.datetime(2024, 1, 1), f"{tmp_path}/pages", f"file://{tmp_path}/feed"
    feed_files(path, [(f"{i:03d}", start + dt.timedelta(days=i % 9), "a") for i in range(25)], 0)
    plain = sinks.append_log

    def broken(*args):
        raise RuntimeError("stopped between the table and the log")

    monkeypatch.setattr(sinks, "append_log", broken)
    with pytest.raises(Exception, match="stopped between"):
        ingest.ingest_feed(spark, path, folder)
    monkeypatch.setattr(sinks, "append_log", plain)
    stopped = sinks.latest(spark, f"{folder}/state")
    assert not stopped["complete"] and stopped["watermark"] is None
    feed_files(path, [(f"1{i:02d}", start, "b") for i in range(4)], 1)  # while it was down
    state = ingest.ingest_feed(spark, path, folder)
    assert (state["mode"], state["run"], state["complete"], state["watermark"], state["rows"]) == ("full", stopped["run"], True, "2024-01-09", 29)
    assert sinks.active(spark, f"{folder}/table").count() == 29
    feed_files(path, [("024", dt.datetime(2024, 1, 9, 5), "late"), ("030", dt.datetime(2024, 2, 1), "new"), ("001", dt.datetime(2023, 1, 1), "older")], 2)
    state = ingest.ingest_feed(spark, path, folder)
    found = {r["violation_id"]: r["status"] for r in sinks.active(spark, f"{folder}/table").collect()}
    assert state["mode"] == "delta" and len(found) == 30 and found["030"] == "new" and found["024"] == "late" and found["001"] == "a" and state["watermark"] == "2024-02-01"
    log = spark.read.parquet(f"{folder}/log").collect()
    assert len({(r["run"], r["batch"]) for r in log}) == len(log) and sum(r["rows"] for r in log) == 29 + state["rows"]
    assert ingest.ingest_feed(spark, path, folder)["complete"] and sinks.active(spark, f"{folder}/table").count() == 30


def test_buckets_double_as_the_table_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BUCKETS", 2)
    monkeypatch.setattr(sinks, "BUCKET_BYTES", 4000)
    folder, merge = f"file://{tmp_path}/t", None
    merge = ingest.upsert_sink(folder, ["k"], "at")
    for i in range(4):
        merge(spark.range(i * 500, i * 500 + 800).select(F.col("id").alias("k"), F.lit(i).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("x")), i)
    rows = sinks.active(spark, folder)
    assert rows.count() == 2300 and rows.select("k").distinct().count() == 2300 and rows.filter("k BETWEEN 500 AND 799").agg(F.min("at")).first()[0] == 1
    now = sinks.latest(spark, folder)
    assert now["n"] > 2 and len(now["buckets"]) == now["n"]
    sinks.clear_history(spark, folder, 1)
    assert sinks.active(spark, folder).count() == 2300


def test_a_feed_takes_the_filters(spark, tmp_path):
    """Pages by class, status and days through the feed's reader, as from the rows themselves."""
    at = dt.datetime(2024, 3, 1)
    rows = [(str(i), "ABC"[i % 3], ["Open", "Closed", None][i % 4 % 3], at + dt.timedelta(hours=7 * i) if i % 11 else None, i / 3 if i % 5 else float("nan"), f"{i} MAIN ST" if i % 2 else None, i) for i in range(600)]
    names = ["violation_id", "class", "status", "inspection_date", "score", "street_name", "number"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.float64(), pa.string(), pa.int64()]
    for part in range(3):
        chunk = list(zip(*rows[part * 200 : part * 200 + 200], strict=True))
        pq.write_table(pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, chunk, strict=True)}), f"{tmp_path}/{part}.parquet", row_group_size=50)
    whole = spark.createDataFrame(rows, "violation_id string, class string, status string, inspection_date timestamp_ntz, score double, street_name string, number long")
    tests = [
        property.page_filter("B", "Open", "2024-04-01", "2024-05-02"), F.col("status").isNull(), F.col("status").isNotNull() & (F.col("violation_id") == "17"), F.col("class").isin("A", "C") & (F.col("score") > 30),
        F.col("street_name").startswith("1") & (F.col("inspection_date") > F.lit("2024-06-01").cast("timestamp_ntz")), ~F.col("status").eqNullSafe("Open"), F.col("violation_id") == "none", F.col("score").isNull() | (F.col("class") == "A"),
    ]
    for test in tests:
        got = feeds.feed(spark, str(tmp_path)).filter(test)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.filter(test).collect()))
    some = feeds.feed(spark, str(tmp_path), ["violation_id", "class"]).filter("class = 'A'")
    assert some.columns == ["violation_id", "class"] and " Filter (" not in some._jdf.queryExecution().executedPlan().toString() and some.count() == 200
    first = feeds.feed(spark, str(tmp_path)).filter("number BETWEEN 60 AND 80")
    assert first.rdd.getNumPartitions() == 1 and first.count() == 21  # the other row groups are left out by their statistics


def test_changed_counts_are_those_that_change(spark, tmp_path):
    for i, users in enumerate(([1, 1, 2], [2, 3])):
        spark.createDataFrame([(u,) for u in users], "u int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("u int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = ingest.changed_counts(stream, f"file://{tmp_path}/out", "u").collect()
    last = {}
    for r in sorted(got, key=lambda r: r["batch"]):
        last[r["u"]] = r["n"]
    assert last == {1: 2, 2: 2, 3: 1} and len({r["batch"] for r in got}) == 2 and len(got) < 6


class Plain(HTMLParser):
    """Visible pieces of a page with their tags, for checking sections by another way."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        while self.stack and self.stack.pop() != tag:
            pass

    def handle_data(self, data):
        if data.split() and not set(self.stack) & {"script", "style", "noscript", "nav", "header", "footer", "svg"}:
            self.found.append((next((t for t in reversed(self.stack) if t in ("h1", "h2", "h3", "h4")), None), " ".join(data.split())))


@here
def test_html_sections_of_all_pages(spark):
    got = {}
    for r in plans.QUERIES["html_sections"](spark, FOLDER).orderBy("page_id", "ordinal").collect():
        got.setdefault(r["page_id"], []).append((r["heading"], r["text"].split("\n")))
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        plain = Plain()
        plain.feed(page["html"] or "")
        want, heading = [[None, []]], []
        for tag, piece in [*plain.found, ("end", "")]:
            if tag in ("h1", "h2", "h3", "h4"):
                heading.append(piece)
                continue
            if heading:
                want.append([" ".join(heading), []])
                heading = []
            want[-1][1].append(piece)
        flat = lambda parts: [(h, x) for h, lines in parts for x in lines if x]
        assert flat(got.get(page["page_id"], [])) == flat(want), page["page_id"]


@here
def test_greedy_chunks_of_all_documents(spark):
    got = {}
    for r in plans.QUERIES["greedy_chunks"](spark, FOLDER).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["paragraph_start"], r["paragraph_end"]))
    for doc in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        want = []
        for n, p in enumerate([p.strip() for p in re.split(r"\n+", doc["text"] or "") if p.strip()], 1):
            whole = len(p) <= 3000 and len(p.encode()) <= 7500
            for piece in [p] if whole else [x for i in range(0, len(p), 1875) if (x := p[i : i + 1875].strip())]:
                joined = f"{want[-1][0]}\n{piece}" if want else piece
                if want and len(joined) <= 2500 and len(joined.encode()) <= 7500:
                    want[-1] = (joined, want[-1][1], n)
                else:
                    want.append((piece, n, n))
        assert got.get(doc["doc_id"], []) == want


@here
def test_unified_diffs_turn_one_text_into_the_other(spark):
    before, after = plans.documents._versions(spark, FOLDER)
    pairs = {r["doc_id"]: (r["a"], r["b"]) for r in before.select("doc_id", F.col("text").alias("a")).join(after.select("doc_id", F.col("text").alias("b")), "doc_id").filter("a <> b").collect()}
    got = {r["doc_id"]: r["diff"] for r in plans.QUERIES["unified_diff"](spark, FOLDER).collect()}
    assert got.keys() == pairs.keys()
    for k, (a, b) in pairs.items():
        old, new, at = a.splitlines(), [], 0
        for line in got[k].split("\n")[2:]:
            if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line):
                start = int(m[1]) - (m[2] != "0")
                new += old[at:start]
                at = start
            elif line[0] in " -":
                assert old[at] == line[1:]
                at += 1
                new += [line[1:]] if line[0] == " " else []
            else:
                new.append(line[1:])
        assert new + old[at:] == b.splitlines() and difflib.SequenceMatcher(None, a, b) is not None
