import io
import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import citations, documents
from corpusmill.functions import text as T
from corpusmill.operators import compare, ledger, property, relations, search
from corpusmill.sources import sinks, tables
from corpusmill.streaming import ingest


def value(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0)).select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (T.collapse, "  a \n b\t", "a b"),
        (T.collapse_lines, " a  b \n\n c ", "a b\nc"),
        (T.search_tokens, "Heat § 27-2005 a heat", ["heat", "27-2005"]),
        (T.meaningful_terms, "What is the heat-season in NYC a", ["heat-season", "nyc"]),
        (T.match_query, 'Heat "§27', '"heat" OR "§27"'),
        (T.clean_encoding, "Â§ 1 tenantâ€™s  â€œx", "§ 1 tenant's \"x"),
        (T.address_part, "12-A", "12A"),
        (T.address_part, " - ", None),
        (T.spreadsheet_safe, " =1+1", "' =1+1"),
        (T.slug, "  Big Title! ", "big-title"),
        (T.canonical_url, "https://a.b/c/?q=1#x", "https://a.b/c"),
        (T.safe_web_url, "javascript:alert(1)", False),
        (T.input_token_bound, "", 1),
        (T.estimated_tokens, "ééé", 2),
        (citations.normalize, "housing maintenance code section 27-2005", "NYC Admin Code § 27-2005"),
        (citations.normalize, "MDL  78", "Multiple Dwelling Law § 78"),
        (citations.normalize, "rpapl § 711-a", "RPAPL § 711-A"),
        (citations.normalize, "Real Property Law 231-c", "Real Property Law § 231-C"),
        (citations.normalize, "section two hundred eleven RPL", "Real Property Law § 211"),
        (citations.normalize, "under section seven-eleven", "RPAPL § 711"),
        (citations.normalize, " something  else ", "something else"),
        (citations.citation_type, "RPAPL 711", "rpapl"),
        (citations.number_in_words, "seventy-eight", 78),
    ],
)
def test_text_function(spark, function, given, wanted):
    assert value(spark, function(F.col("x")), x=given) == wanted


def test_money_rounds_half_to_even(spark):
    got = spark.sql("SELECT cast('1.123456785' AS decimal(20,10)) AS a, cast('1.123456775' AS decimal(20,10)) AS b").select(T.money(F.col("a")), T.money(F.col("b"))).first()
    assert [str(x) for x in got] == ["1.12345678", "1.12345678"]


def test_lenient_dates(spark):
    given = ["2024-02-03T04:05:06.789", "2024-02-03T04:05:06", "2024-02-03", "03/02/2024", "", None, "9999-12-11T00:00:00.000"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string").select("i", T.lenient_date(F.col("x")).alias("d")).orderBy("i").collect()
    assert [str(r["d"]) for r in rows] == ["2024-02-03"] * 3 + ["None"] * 3 + ["9999-12-11"]


def test_json_flag(spark):
    rows = spark.createDataFrame([('{"f": false}',), ('{"f": 0}',), ("{}",), ("broken",), (None,)], "j string")
    assert [r[0] for r in rows.select(T.json_flag(F.col("j"), "f")).collect()] == [False, True, True, True, True]


def test_expansion_and_hints(spark):
    rules = [(r"(?i)heat", ["minimum", "heat"]), (r"(?i)rent", ["DHCR"])]
    assert value(spark, T.expand_terms(F.col("q"), rules), q="Heat of the rent") == ["heat", "rent", "minimum", "DHCR"]
    assert value(spark, T.expand_text(F.col("q"), rules), q="heat") == "heat minimum"
    assert value(spark, T.first_hint(F.col("q"), [("b", "two"), ("a", "one")]), q="ab") == "two"


def test_citations_keep_the_first_spelling(spark):
    rows = citations.extract(spark.createDataFrame([(1, "MDL 78, 27-2005 and Multiple Dwelling Law § 78; § 27-2005")], "id int, t string"), "t", "id").collect()
    assert [(r["citation_text"].strip(), r["normalized_citation"]) for r in rows] == [("27-2005", "NYC Admin Code § 27-2005"), ("MDL 78", "Multiple Dwelling Law § 78")]


def test_html_sections():
    page = "<nav>menu</nav><p>Intro</p><h1>One &amp; only</h1><p>a  b</p><script>x()</script><li>c</li><h2>Empty</h2><footer>z</footer>"
    assert documents.html_sections(page) == [(None, "Intro"), ("One & only", "a b\nc")]
    assert documents.html_sections(None) == []


def test_packing_keeps_text_and_limits():
    text = "\n".join("p" * n for n in (10, 2400, 200, 7000, 5, 0, 3))
    packed = documents.pack(text)
    assert "".join(t.replace("\n", "") for t, _, _ in packed) == text.replace("\n", "")
    assert all(len(t) <= documents.MOST_CHARS for t, _, _ in packed) and packed[0][1:] == (1, 2)
    assert documents.pack("") == []


def test_sections_split_and_best(spark):
    text = "intro\n§ 1. Title.\n2. Other\n3. More\n§ 2. B\nbody\n§ 1. Title. Real.\nlong body"
    rows = documents.split_at(spark.createDataFrame([(1, text)], "id int, t string"), "t", r"^§\s*(\d+)\.", "id")
    best = {r["section"]: r["body"] for r in documents.best_section(rows, "id").collect()}
    assert best == {"1": "§ 1. Title. Real.\nlong body", "2": "§ 2. B\nbody"}


def test_xml_in_zip(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.xml", '<R><LEVEL style-name="Section"><RECORD><HEADING>§ 1 <b>T</b></HEADING><PARA>x  y</PARA><PARA/></RECORD></LEVEL><LEVEL/></R>')
        z.writestr("b.txt", "no")
    rows = documents.xml_sections(spark.createDataFrame([(1, bytearray(buffer.getvalue()))], "id int, c binary"), "c", "id").collect()
    assert [tuple(r) for r in rows] == [(1, "ok", "a.xml", "§ 1 T", "x y")]


def test_archives_that_cannot_be_read_say_why(spark):
    """A broken archive, or a broken member of a sound one, is a row with a status; the other rows aren't lost."""
    def package(**members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members.items():
                z.writestr(f"{name}.xml", body)
        return buffer.getvalue()

    sound = '<R><LEVEL style-name="Section"><HEADING>§ 9</HEADING><PARA>t</PARA></LEVEL></R>'
    mixed = package(a="<R><LEVEL", b=sound)
    at = mixed.index(b"<R") if b"<R" in mixed else None
    damaged = bytearray(package(a=sound * 1, b=sound))
    damaged[40] ^= 255
    blobs = [None, b"", b"no archive", mixed, bytes(damaged), package(a="<R>" + " " * 50_000_000 + "</R>"), mixed[:-30]]
    rows = documents.xml_sections(spark.createDataFrame([(i, b if b is None else bytearray(b)) for i, b in enumerate(blobs)], "id int, c binary"), "c", "id").collect()
    got = [(r["id"], r["status"], r["member"], r["heading"]) for r in rows]
    assert at is None and got == [(0, "empty", None, None), (1, "empty", None, None), (2, "not_a_package", None, None), (3, "broken_xml", "a.xml", None), (3, "ok", "b.xml", "§ 9"), (4, "broken_member", "a.xml", None), (4, "ok", "b.xml", "§ 9"), (5, "too_large", None, None), (6, "not_a_package", None, None)]


def test_batches(spark):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([5, 5, 5, 100, 1, 1])], "i int, t string").coalesce(1)
    assert [r["batch"] for r in documents.batches_by_budget(rows, "t", 2, 12).collect()] == [0, 0, 1, 2, 3, 3]


def test_vectors(spark):
    assert value(spark, search.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert value(spark, search.unit(F.array(F.lit(0.0)))) == [0.0]
    assert value(spark, search.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert value(spark, documents.decode_vector(F.lit(bytearray(b"\0\0\x80\x7f")))) is None


def test_sections_and_diff(spark):
    before = spark.createDataFrame([(1, "same", "a"), (2, "old", "a"), (3, "gone away", "a"), (4, "x", "a"), (5, "dup", "a"), (6, "dup", "a")], "k int, t string, m string")
    after = spark.createDataFrame([(1, "same ", "a"), (2, "new", "a"), (13, "gone away", "a"), (4, "x", "b"), (15, "dup", "a"), (7, "fresh", None)], "k int, t string, m string")
    got = {r["k"]: r["classification"] for r in compare.changes(before, after, "k", "t", ["m"]).collect()}
    assert got == {1: "unchanged", 2: "text_changed", 3: "uncertain", 13: "uncertain", 4: "metadata_only", 5: "removed", 6: "removed", 15: "added", 7: "added"}
    parser = {r["k"]: r["classification"] for r in compare.changes(before, after, "k", "t", ["m"], True, True).collect()}
    assert parser[1] == parser[4] == "parser_only"
    assert value(spark, compare.unified_diff(F.lit("a\nb"), F.lit("a\nc"))).splitlines()[-2:] == ["-b", "+c"]


def test_ledger_precedence(spark):
    rows = [(1, "reserve", 1, 1, 5, "reserved"), (1, "settle", 2, 2, 4, "settled"), (1, "uncertain", 3, 9, 9, "uncertain"), (2, "settle", 4, 1, 1, "settled"), (3, "reserve", 5, 1, 2, "reserved"), (3, "reserve", 6, 1, 3, "reserved")]
    events = spark.createDataFrame(rows, "attempt_id int, event_type string, event_id int, ts int, amount int, status string")
    assert {r["attempt_id"]: (r["status"], r["amount"]) for r in ledger.attempt_states(events).collect()} == {1: ("settled", 4), 3: ("reserved", 3)}


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"2024-01-{1 + i % 5:02d}") for i in range(30)], "violation_id int, d string").withColumn("inspection_date", F.col("d").cast("timestamp_ntz"))
    seen, cursor = [], None
    while True:
        page = property.page(rows, 7, cursor).orderBy("position").collect()
        seen += [r["violation_id"] for r in page]
        if not page[-1]["has_more"]:
            break
        last = page[-1]
        cursor = (str(last["inspection_date"]) if last["inspection_date"] else None, last["violation_id"])
    assert seen == [r["violation_id"] for r in property.ordered(rows).collect()]


def test_snapshots_swap_and_roll_back(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    first = sinks.publish(spark.range(3), folder)
    second = sinks.publish(spark.range(5), folder)
    assert sinks.active(spark, folder).count() == 5 and sinks.history(spark, folder) == [first, second]
    assert sinks.roll_back(spark, folder) == first and sinks.active(spark, folder).count() == 3
    sinks.publish(spark.range(9), folder, activate=False)
    assert sinks.active(spark, folder).count() == 3
    sinks.activate_generation(spark, folder, second)
    assert sinks.active(spark, folder).count() == 5


def test_exports_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("=1", 2), ("a,b", 3)], "a string, b int")
    sinks.export_csv(rows, f"file://{tmp_path}/csv", ["a", "b"], {"what": "counts"})
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv/rows")
    assert sorted(map(tuple, back.collect())) == [("'=1", "2"), ("a,b", "3")]
    blobs = lambda *x: spark.createDataFrame([(bytearray(b),) for b in x], "content binary")
    assert sinks.store_artifacts(blobs(b"a", b"b", b"a"), f"file://{tmp_path}/blobs").count() == 2
    assert sinks.store_artifacts(blobs(b"b", b"c"), f"file://{tmp_path}/blobs").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"violationid": "1", "boro": "", "other": 5}\nbroken\n')
    rows = tables.property_pages(spark, f"file://{tmp_path}/p.json").collect()
    assert rows[0]["violationid"] == "1" and rows[0]["boro"] is None and rows[1]["_corrupt"] == "broken"
    (tmp_path / "a.md").write_text("# hi")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.7")
    kinds = {r["path"].rpartition("/")[2]: r["media_type"] for r in tables.files(spark, f"file://{tmp_path}/*.[mb]*").collect()}
    assert kinds == {"a.md": "text/markdown", "b.bin": "application/pdf"}
    pages = tables.bundle_pages(spark.createDataFrame([('{"format": "x", "pages": [{"url": "u", "html": "<p>"}, {"url": "v"}]}',)], "c string"), "c")
    assert [r["url"] for r in pages.collect()] == ["u"]
    assert tables.synthetic_chunks(spark, 3, 4).select("embedding").collect()[1][0] == [0, 1, 0, 0]


def test_upsert_is_idempotent_and_ordered(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    once = relations.upsert(old, new, ["k"], [F.desc("n")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, relations.upsert(once, new, ["k"], [F.desc("n")]).collect())) == sorted(map(tuple, once.collect()))


def test_rejected_events_do_not_count():
    times, allowed = [], []
    for at in (0, 1, 2, 3, 11, 12):
        ok, times = ingest.admit(times, at, 10, 2)
        allowed.append(ok)
    assert allowed == [True, True, False, False, True, True]


def test_check_and_record_equals_a_loop(spark, tmp_path):
    from pathlib import Path

    from corpusmill import plans

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("the data folder isn't here")
    got = {r["event_id"]: r["allowed"] for r in plans.QUERIES["stream_check_and_record"](spark, folder).collect()}
    state: dict = {}
    rows = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").collect()
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        key = (r["user_id"], r["event_type"])
        ok, state[key] = ingest.admit(state.get(key, []), r["at"], 86_400_000_000, 3)
        assert got[r["event_id"]] == ok
    assert len(got) == len(rows)


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>new </w:t></w:r><w:del><w:r><w:t>old</w:t></w:r></w:del><w:ins><w:r><w:t>text</w:t></w:r></w:ins></w:p><w:p/></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    rows = spark.createDataFrame([(1, bytearray(buffer.getvalue())), (2, bytearray(b"no zip")), (3, None)], "id int, c binary")
    got = [tuple(r) for r in documents.docx_paragraphs(rows, "c", "id").collect()]
    assert got == [(1, "ok", 0, "Heading1", "Title"), (1, "ok", 1, None, "new text"), (2, "not_a_package", None, None, None), (3, "empty", None, None, None)]


def test_a_worker_holds_the_parts_of_a_portion_only():
    import pyarrow as pa

    seen, batch = [], pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array([None, "a b"] * 125)], ["id", "_text"])
    parse = lambda t: seen.append(t) or list(enumerate((t or "").split()))
    out, rows = documents.in_portions(iter([batch]), ["id", "n", "w"], [pa.int32(), pa.string()], parse), []
    for part in out:
        assert len(seen) - len(rows) <= documents.PORTION  # two parts a text with any, so as many as texts
        rows += part.to_pylist()
    assert rows == [{"id": i, "n": n, "w": w} for i in range(1, 250, 2) for n, w in enumerate("ab")]


def plain_bm25(chunks, query, weights):
    """Scores by a loop over whole texts: what a full-text index with phrases gives. chunks: id -> texts of the fields."""
    import math

    fold = lambda t: [w for w in re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))]
    held = {i: [fold(t or "") for t in texts] for i, texts in chunks.items()}
    mean = sum(len(f) for fs in held.values() for f in fs) / len(held)
    scores = {}
    for token in dict.fromkeys(t for t in re.findall(r"[\w§-]+", query.lower()) if len(t) > 1):
        p = fold(token)
        if not p:
            continue
        count = {i: sum(w for f, w in zip(fs, weights) for at in range(len(f)) if f[at : at + len(p)] == p) for i, fs in held.items()}
        found = {i: c for i, c in count.items() if c}
        idf = max(math.log((len(held) - len(found) + 0.5) / (len(found) + 0.5)), 1e-6)
        for i, f in found.items():
            scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(map(len, held[i])) / mean))
    return {i: round(s, 9) for i, s in scores.items()}


def test_index_finds_words_and_phrases_without_diacritics(spark, tmp_path):
    texts = {
        1: ("Heat", "code 27-2005", "The owner shall provide heat. Section 27-2005 applies, and 2005 rules."),
        2: ("Año nuevo", None, "El año 2005 trae 27 señales; 2005-27 no."), 3: (None, "27 2005", "27 2005 2005"), 4: ("", "", None), 5: ("ÉTÉ", "x", "L'été à Montréal, the-the the the"),
    }
    rows = spark.createDataFrame([(i, *t) for i, t in texts.items()], "chunk_id long, title string, citation string, text string")
    index = search.save_index(rows, ["title", "citation", "text"], f"file://{tmp_path}/index")
    queries = {1: "27-2005", 2: "ano ete montreal", 3: "heat 27-2005 señales", 4: "the-the", 5: "2005 27", 6: "§ ? a", 7: "owner-shall-provide heat-owner"}
    asked = search.ask(spark.createDataFrame(list(queries.items()), "query_id long, query string"), "query", "query_id")
    got = {}
    for r in search.bm25(index, asked, [10.0, 8.0, 1.0], "query_id").collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = round(r["score"], 9)
    assert got == {q: want for q, t in queries.items() if (want := plain_bm25(texts, t, [10, 8, 1]))}
    for k in (1, 2, 9):
        best = search.best_by_bm25(index, asked, [10.0, 8.0, 1.0], k, "query_id").collect()
        want = {(q, c, n) for q, scores in got.items() for n, c in enumerate(sorted(scores, key=lambda c: (-scores[c], c))[:k], 1)}
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in best} == want
        assert all(round(r["score"], 9) == got[r["query_id"]][r["chunk_id"]] for r in best)
    assert set(got[1]) == {1, 3} and set(got[2]) == {2, 5} and set(got[7]) == {1}
    one = {r["chunk_id"]: round(r["score"], 9) for r in search.best_for(index, "Heat 2005", [10.0, 8.0, 1.0], 9).collect()}
    assert one == plain_bm25(texts, "heat 2005", [10, 8, 1])
    assert search.save_index(rows.limit(0), ["title", "text"], f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("block", "scores"), [(1000, 200_000), (3, 7)])
def test_batches_score_chunks_where_they_lie(spark, tmp_path, monkeypatch, block, scores):
    """The best of a batch are those of a plain loop, in blocks of any size, with a filter and hints, and among copies."""
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "SCORES", scores)
    rng = random.Random(11)
    words = ["the", "of", "heat", "lease", "rent", "übel", "27", "2005", "repair", "x"]
    texts = {i: (rng.choice([None, "", "Heat the"]), " ".join(rng.choices(words, [9, 8, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.choice([0, 3, 12, 40])))) for i in range(60)}
    texts |= {100 + i: texts[7] for i in range(20)}
    rows = spark.createDataFrame([(i, *t) for i, t in texts.items()], "chunk_id long, title string, text string").repartition(5)
    queries = ["the of", "27-2005 rent", "heat-the lease", "ubel repair the-of-heat", "absent", "", "of-the of-the-of x"]
    asked = spark.createDataFrame([(q, h) for q in queries for h in (None, "s1")] + [(None, None), (queries[0], None)], "query string, hint string")
    index = search.save_tokens(rows, ["title", "text"], f"file://{tmp_path}/tokens")
    passing = spark.createDataFrame([(i, f"s{i % 3}") for i in texts if i % 2], "chunk_id long, source string")
    got = {}
    best = search.best_of_batch(index, asked, [10.0, 1.0], 9, passing)
    for r in best.collect():
        got.setdefault((r["query"], r["hint"]), []).append((r["rank"], r["chunk_id"], round(r["score"], 9)))
    want = {}
    for q in queries:
        held = plain_bm25(texts, q, [10, 1])
        for h in (None, "s1"):
            ids = sorted((i for i in held if i % 2 and (h is None or i % 3 == 1)), key=lambda i: (-held[i], i))[:9]  # noqa: B023
            if ids:
                want[q, h] = [(n, i, held[i]) for n, i in enumerate(ids, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want
    by_terms = search.save_index(rows, ["title", "text"], f"file://{tmp_path}/terms")
    pruned = search.best_by_bm25(by_terms, search.ask(asked.filter("hint IS NULL").distinct(), "query", "query"), [10.0, 1.0], 9, "query", eligible=passing)
    assert {(r["query"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in pruned.collect()} == {(q, *x) for (q, h), xs in want.items() if h is None for x in xs}


def test_term_overlap_is_added_up_where_chunks_lie(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "SCORES", 5)
    texts = {1: ("Heat", "c-1", "heat and rent"), 2: (None, "heat", "rents"), 3: ("x", None, "none")}
    asked = {1: "heat rent heat", 2: "c-1", 3: "absent", 4: "", 5: "ren heat"}
    chunks = spark.createDataFrame([(i, *t) for i, t in texts.items()], "chunk_id long, title string, citation string, text string")
    found = search.term_overlap(chunks, spark.createDataFrame(list(asked.items()), "query_id int, query string"), "title", "citation", "text")
    want = {(1, 1): 5 / 3, (1, 2): 5 / 3, (2, 1): 2.0, (5, 1): 1.5, (5, 2): 1.5}
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in found.collect()} == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_in_small_portions_give_k_rows_a_batch(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES", 8)
    rng = random.Random(6)
    held = {i: [float(rng.randrange(5)), float(rng.randrange(5))] for i in range(90)}
    vectors = spark.createDataFrame(list(held.items()), "chunk_id long, embedding array<double>").coalesce(1)
    asked = {q: [float(q), 1.0] for q in range(3)}
    found = search.vector_top_k(vectors, spark.createDataFrame(list(asked.items()), "query_id long, vector array<double>"), 4)
    score = lambda q, i: sum(a * b for a, b in zip(asked[q], held[i], strict=True))
    want = {(q, n, i) for q in asked for n, i in enumerate(sorted(held, key=lambda i: (-score(q, i), i))[:4], 1)}  # noqa: B023
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in found.collect()} == want


@pytest.mark.parametrize("block", [1000, 1])
def test_vector_top_k_equals_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    held = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(50)] + [(90, [1.0]), (91, None), (92, [float("nan")] * 3)]
    asked = [(1, [1.0, 0.0, 0.0]), (2, [0.0, -1.0, 0.5]), (3, None), (4, [2.0])]
    vectors = spark.createDataFrame(held, "chunk_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    for positive in (False, True):
        want = set()
        for q, v in asked:
            scores = [(-sum(a * b for a, b in zip(x, v)) if len(x) == len(v) else -0.0, i) for i, x in held if x] if v else []
            scores = sorted((s, i) for s, i in scores if s == s and (s < 0 or not positive))
            want |= {(q, i, -s, n) for n, (s, i) in enumerate(scores[:6], 1)}
        assert {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in search.vector_top_k(vectors, queries, 6, positive).collect()} == want
    assert search.vector_top_k(vectors, queries.limit(0), 6).count() == 0


def test_decorated_results(spark):
    columns = "chunk_id int, source_name string, publisher string, jurisdiction string, origin string, provenance_json string, locator_json string"
    rows = [(1, "Code", "City", "nyc", "official", '{"title": "", "authority_category": "law"}', '{"page": 2}'), (2, "Mine", "x", "y", "user", '{"title": "My notes", "publisher": "Me"}', "[1]"), (3, "Bad", "p", "j", "official", "no json", None)]
    got = {r["chunk_id"]: r.asDict() for r in search.decorated(spark.createDataFrame(rows, columns)).collect()}
    assert got[1] | {"locator_json": "{}"} == {"chunk_id": 1, "source_name": "Code", "publisher": "City", "jurisdiction": "nyc", "origin": "official", "locator_json": "{}", "category": "law"}
    assert (got[2]["source_name"], got[2]["publisher"], got[2]["jurisdiction"], got[2]["category"], got[2]["locator_json"]) == ("My notes", "Me", "", "official", "{}")
    assert got[1]["locator_json"] == '{"page": 2}' and got[3]["category"] == "official" and got[3]["locator_json"] == "{}"


def test_searchable_and_matching(spark):
    rows = spark.createDataFrame([(1, True, "public_web", "open_data", True, "a", True), (2, True, "login", "open_data", True, "a", True), (3, None, "public_api", "open_data", True, "b", None)], "id int, active boolean, access string, licence string, current boolean, slug string, model boolean")
    assert [r["id"] for r in rows.filter(search.searchable(*map(F.col, ("active", "access", "licence", "current")))).collect()] == [1]
    assert [r["id"] for r in rows.filter(search.matching({"source": "slug"}, "model", source="a")).collect()] == [1, 2]
    assert rows.filter(search.matching({"source": "slug"}, source=None)).count() == 3
    merged = rows.select("id", F.lit(1.0).alias("score"), F.lit("a").alias("hint"), F.col("slug").alias("source"))
    assert [r["score"] for r in search.boosted(merged).orderBy("id").collect()] == [3.0, 3.0, 1.0]
