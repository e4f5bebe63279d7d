"""Functions with the rows that they must give."""

import base64
import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import documents, guidance, routing
from corpusmill.functions import text as T
from corpusmill.operators import answers, compare, operations


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").select("_i", column.alias("v")).orderBy("_i").select("v").collect()]


def test_routes(spark):
    questions = {
        "Show HPD violations at 123 MAIN STREET": "property_signal_with_identifier",
        "building 12345": "property_signal_with_identifier",
        "Registration 778 please": "property_signal_with_identifier",
        "How can a tenant report a housing complaint to HPD?": "default_legal",
        "What HPD enforcement information is available for tenants and owners?": "default_legal",
        "What does Housing Maintenance Code section 27-2005 require for building ID 1?": "default_legal",
        "Show HPD violations": "property_lookup_missing_identifier",
        "look up my address": "property_lookup_missing_identifier",
        "What is rent?": "default_legal",
    }
    assert values(spark, routing.route(F.col("q"))["reason"], [(q,) for q in questions], "q string") == list(questions.values())


def test_identifiers(spark):
    ids = routing.identifiers(F.col("q"))
    rows = ["Show HPD violations at 35-20A QUEENS BOULEVARD", "building id: 77 at 12 Main St", "registration #9", "violations at 12 main st in New York 10001", "nothing", "hpd at 123 MAIN STREET open"]
    got = values(spark, F.struct(*(c.alias(n) for n, c in ids.items())), [(q,) for q in rows], "q string")
    assert [tuple(r) for r in got] == [
        (None, None, "35-20A", "QUEENS BOULEVARD", None), ("77", None, None, None, None), (None, "9", None, None, None),
        (None, None, "12", "MAIN ST", "10001"), (None,) * 5, (None, None, "123", "MAIN STREET", None),
    ]


def test_a_house_number_is_no_zip_code(spark):
    ids = routing.identifiers(F.col("q"))
    rows = ["see 10001-7A main st in NYC 10033 violations", "see 10025 Broadway", "zip 10001, 5 Main Street", "10025 Broadway 10026"]
    got = values(spark, F.struct(ids["house_number"], ids["zip_code"]), [(q,) for q in rows], "q string")
    assert [tuple(r) for r in got] == [("10001-7A", "10033"), ("10025", None), ("5", "10001"), ("10025", "10026")]


def test_rules_triggers_and_cards(spark):
    rules = [{"rule_id": "a", "pattern": "(?i)heat", "priority": 1}, {"rule_id": "b", "pattern": "heat", "unless": "no heat bill", "priority": 5}, {"rule_id": "c", "pattern": ".", "lang": "es"}]
    asked = spark.createDataFrame([(1, "Heat", "en"), (2, "heat", "es"), (3, "no heat bill", None)], "id int, text string, lang string")
    assert sorted((r["id"], r["rule_id"], r["place"]) for r in routing.matching_rules(asked, "text", rules).collect()) == [(1, "a", 1), (2, "a", 2), (2, "b", 1), (2, "c", 3), (3, "a", 1)]
    packs = spark.createDataFrame([("p", ["Rent Law", "x y"]), ("q", []), ("r", ["heat"])], "pack string, terms array<string>")
    assert sorted((r["id"], r["pack"]) for r in routing.term_triggers(spark.createDataFrame([(1, "the  RENT  law and heat"), (2, "x  y"), (3, None)], "id int, t string"), "t", packs, "pack", "terms").collect()) == [(1, "p"), (1, "r"), (2, "p")]
    cards = spark.createDataFrame([(1, "en", ["heat"], ["court"]), (2, "en", ["heat"], ["any"]), (3, "es", ["heat"], ["any"]), (4, "en", ["rent"], ["any"])], "id int, lang string, topics array<string>, contexts array<string>")
    assert [r["id"] for r in routing.cards_for(cards, "en", "heat", "home").collect()] == [2] and routing.cards_for(cards, "en").count() == 3


def test_dates_flags_and_values_in_json(spark):
    dates = ["2024-1-5", "2024-01-05T03:04:05.5", "2024-1-5T3:4:5", "05/01/2024", "", None, "2024-13-01", "2024-01-05x"]
    assert [None if d is None else d.isoformat() for d in values(spark, T.lenient_date(F.col("d")), [(d,) for d in dates], "d string")] == ["2024-01-05"] * 3 + [None] * 5
    flags = ['{"cost_known": "false"}', '{"cost_known": false}', '{"cost_known": null}', "{}", "broken", None, '{"cost_known": 0}', '{"cost_known": true}', "[false]"]
    assert values(spark, T.json_flag(F.col("j"), "cost_known"), [(j,) for j in flags], "j string") == [True, False, True, True, True, True, True, True, True]
    doc = {"id": 'a"b', "list": [{"id": "café"}, {"id": 3, "deep": {"id": "c\\d\n"}}], "text": '"id": "no"'}
    escaped = '{"a": [{"chunk\\u005fid": "x"}, {"chunk_id": "y"}, {"chunk\\u005FId": "no"}], "\\u0063hunk_id" : "z"}'
    assert values(spark, operations.find_values(F.col("j"), "chunk_id"), [(escaped,)], "j string") == [["x", "y", "z"]]
    assert values(spark, operations.find_values(F.col("j"), "id"), [(json.dumps(doc),), (json.dumps(doc, ensure_ascii=False),)], "j string") == [['a"b', "café", "c\\d\n"]] * 2
    assert values(spark, T.json_object(F.col("j")), [('{"a": 1}',), ("[1]",), ("x",), (None,)], "j string") == ['{"a": 1}', "{}", "{}", "{}"]


def test_texts_are_compared_in_normal_form(spark):
    schema = "k int, t string"
    before = spark.createDataFrame([(1, "café a"), (2, "x"), (3, "gone"), (4, "moved here"), (5, None)], schema)
    after = spark.createDataFrame([(1, "café  a"), (2, "y"), (9, "new"), (8, "moved  here"), (5, "")], schema)
    got = {r["k"]: r["classification"] for r in compare.changes(before, after, "k", "t", []).collect()}
    assert got == {1: "unchanged", 2: "text_changed", 3: "removed", 9: "added", 4: "uncertain", 8: "uncertain", 5: "unchanged"}


def test_embeddings_for_tests(spark):
    def bag(text, n):
        v = [0.0] * n
        for w in text.lower().split():
            d = hashlib.sha256(w.encode()).digest()
            v[d[0] % n] += int.from_bytes(d[1:3], "big") / 65535 + 0.01
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else v

    def seed(text, n):
        d = hashlib.sha256(text.encode()).digest()
        v = [d[i % 32] / 255 * 2 - 1 for i in range(n)]
        size = sum(x * x for x in v) ** 0.5 or 1
        return [x / size for x in v]

    texts = ["Heat and hot water", "", "a a B", "é"]
    for got, want in ((documents.hash_embedding(F.col("t"), 16), bag), (T.seed_embedding(F.col("t"), 40), seed)):
        assert all(g == pytest.approx(want(t, len(g))) for g, t in zip(values(spark, got, [(t,) for t in texts], "t string"), texts))


def test_segments_costs_and_labels(spark):
    assert values(spark, T.embedding_segments(F.col("t"), 10), [("short",), ("one two three four",), ("abcdefghijklmnop qr",), ("0123456789 ab",)], "t string") == [["short"], ["one two", "three four"], ["abcdefghij", "klmnop qr"], ["0123456789", "ab"]]
    cost = T.token_cost(F.col("a"), F.col("b"), F.col("x").cast("decimal(18,8)"), F.col("y").cast("decimal(18,8)"))
    costs = values(spark, cost, [(1000, 500, "0.15", "0.6"), (1, 0, "0.005", None), (3, 0, "0.005", None), (5, 5, None, "1")], "a long, b long, x string, y string")
    assert costs == [Decimal("0.00045"), Decimal(0), Decimal("0.00000002"), None]
    labels = ['{"pdf_page": 3}', '{"paragraph_start": 1, "paragraph_end": 4}', '{"paragraph_start": 2, "paragraph_end": 2}', '{"section": "26-501"}', "{}", None]
    assert values(spark, T.locator_label(F.col("l")), [(x,) for x in labels], "l string") == ["PDF page 3", "paragraphs 1-4", "paragraph 2", "26-501", "not supplied", "not supplied"]


def test_canonical_addresses(spark):
    assert values(spark, T.canonical_house(F.col("x")), [(" 35-20a ",), ("1/2",), ("",), (None,)], "x string") == ["35-20A", None, None, None]
    assert values(spark, T.canonical_street(F.col("x")), [("stagg st",), ("Ocean  Ave.",), ("St Marks Pl",), ("5th Av, Rd",), ("a_b",)], "x string") == ["STAGG STREET", "OCEAN AVENUE", "ST MARKS PL", "5TH AV ROAD", None]
    assert values(spark, T.canonical_borough(F.col("x")), [("3",), ("bk",), ("staten  island",), ("Jersey",)], "x string") == ["BROOKLYN", "BROOKLYN", "STATEN ISLAND", None]


def test_cursors(spark):
    made = T.encode_cursor(F.lit("h?>"), F.col("b"), F.col("d"), F.col("v"))
    cursors = values(spark, made, [("12", "2024-01-01T00:00:00.000", "9"), ("12", None, "10"), ("x", None, "10")], "b string, d string, v string")
    assert json.loads(base64.urlsafe_b64decode(cursors[0])) == {"building_id": "12", "inspection_date": "2024-01-01T00:00:00.000", "request_hash": "h?>", "violation_id": "9"}
    back = lambda h: [None if r is None else tuple(r) for r in values(spark, T.decode_cursor(F.col("c"), F.lit(h)), [(c,) for c in [*cursors, "!!", None]], "c string")]
    assert back("h?>") == [("12", "2024-01-01T00:00:00.000", "9"), ("12", None, "10"), None, None, None] and back("other") == [None] * 5


def test_keys_of_pages(spark):
    url = "https://www.example.org/site/heat-and-hot-water.page?x=1"
    assert values(spark, T.title_from_url(F.col("u")), [(url,), ("https://example.org/",)], "u string") == ["Heat And Hot Water", "HPD Guidance"]
    assert values(spark, T.document_key(F.col("u")), [(url,)], "u string") == ["heat-and-hot-water-" + hashlib.sha1(url.encode()).hexdigest()[:8]]
    assert values(spark, T.section_key(F.col("t"), F.col("n")), [("Heat & Water!", 2), ("§§", 3)], "t string, n int") == ["heat-water-" + hashlib.sha1("2:Heat & Water!".encode()).hexdigest()[:6], "section-3-" + hashlib.sha1("3:§§".encode()).hexdigest()[:6]]


PAGE = """<html><head><title>Heat and Hot Water - City</title></head><body><nav>Search all NYC.gov websites<img src=x></nav>
<aside><p>Affordable Housing</p><p>Compliance</p></aside><main><h1>Heat and Hot Water</h1><p>Owners are required to provide heat and hot water to tenants.</p>
<h2>Report a Heat Complaint</h2><p>Tenants can report a heat<br>or hot water complaint to 311.</p><ul><li>Inspectors may issue violations.</li></ul><h3>Tiny</h3><p>x</p></main>
<div class="site-footer"><p>Not content at all, although it is long enough to count.</p></div><footer>© City of New York. 2026 All Rights Reserved.</footer></body></html>"""
INDEX = """<div class="about-links"><ul><li>Code Enforcement</li></ul></div><div class="span6 about-description"><h1 class="sr-only">Enforcement</h1>
<ul class="index-list"><li><a>About Code Enforcement</a>Learn how the housing code is enforced.</li></ul><h2>Enforcement Programs</h2><ul><li><a>7A Program</a>Apply to be an administrator.</li></ul></div><p>After the container there is more.</p>"""


def test_guidance_pages():
    assert [t for t, _ in guidance.page_sections(PAGE, "x")] == ["Heat and Hot Water", "Report a Heat Complaint"]
    text = "\n".join(x for _, x in guidance.page_sections(PAGE, "x"))
    assert "report a heat or hot water" in text and "Inspectors may issue violations." in text
    assert not any(w in text for w in ("Search", "Affordable", "Compliance", "©", "Not content"))
    index = guidance.page_sections(INDEX, "x")
    assert [t for t, _ in index] == ["Enforcement", "Enforcement Programs"] and "7A Program" in index[1][1] and "After" not in str(index)
    assert guidance.page_sections("<div>Plain words</div><script>no</script> more", "T") == [("T", "Plain words\nmore")]
    assert guidance.page_sections(None, "T") == guidance.page_sections("<nav>x</nav>", "T") == []
    assert guidance.page_sections("<title>Named</title><p>Text before any heading, long enough to count as one.</p>", "T")[0][0] == "Named"


def test_plain_text_of_a_page_is_its_overview(spark):
    pages = [("https://e.org/heat-and-hot-water.page", "<div>Plain words without any block.</div>"), ("https://e.org/", "Words"), ("https://e.org/a.page", PAGE)]
    rows = guidance.guidance_sections(spark.createDataFrame(pages, "url string, html string"), "url", "html").collect()
    assert [(r["section_key"], r["title"]) for r in rows[:2]] == [("overview", "Heat And Hot Water"), ("overview", "HPD Guidance")] and "overview" not in [r["section_key"] for r in rows[2:]]
    assert values(spark, T.document_key(F.col("u")), [("https://e.org/",)], "u string")[0].startswith("hpd-guidance-")


def test_a_tag_without_an_end_does_not_lengthen_its_container():
    page = f"<div class='{guidance.CONTAINER}'><h2>Inside</h2><p>Enough words to count<br>as a section of its own.</p></div><p>Behind the container there is more text of enough length.</p>"
    assert guidance.page_sections(page, "T") == [("Inside", "Inside\nEnough words to count as a section of its own.")]


def test_guidance_sections(spark):
    rows = guidance.guidance_sections(spark.createDataFrame([(1, "https://e.org/heat.page", PAGE), (2, "https://e.org/x", None)], "id int, url string, html string"), "url", "html", None, "id").collect()
    assert [(r["id"], r["ordinal"], r["title"]) for r in rows] == [(1, 0, "Heat and Hot Water"), (1, 1, "Report a Heat Complaint")] and rows[0]["section_key"].startswith("heat-and-hot-water-")


def test_answer_checks(spark):
    assert values(spark, answers.personal_scenario(F.col("q")), [("Can my landlord evict?",), ("Will I win",), ("What is heat?",), (None,)], "q string") == [True, True, False, False]
    assert values(spark, answers.outcome_prediction(F.col("q")), [("Your case will likely fail.",), ("Courts decide.",)], "q string") == [True, False]
    assert values(spark, answers.valid_citations(F.col("c"), F.col("r")), [(["b", "a", "b", "z"], ["a", "b"])], "c array<string>, r array<string>") == [["b", "a"]]
    text = "Heat is due (c-1, c-10) .\nSources: c-1, c-10\n\n\n\nEnd (c-1) ."
    assert values(spark, answers.without_ids(F.col("t"), F.col("i")), [(text, ["c-1", "c-10", "c-1"])], "t string, i array<string>") == ["Heat is due (, ).\nEnd."]
    passes = answers.case_passes(*(F.col(c) for c in "abcdef"))
    rows = [("unsupported", "unsupported", [], [], None, []), ("cite", "answered", ["x"], ["y"], None, []), ("cite", "answered", ["x"], ["x"], "s", ["s"]), ("cite", "answered", [], [], "s", []), ("cite", "error", [], [], None, [])]
    assert values(spark, passes, rows, "a string, b string, c array<string>, d array<string>, e string, f array<string>") == [True, False, True, False, False]


def test_expectations_and_runs(spark):
    schema = "id int, expected_status string, min_citation_count int, required_source_name_contains string, required_source_type string, required_citation_contains string, required_answer_terms array<string>, answer string, answer_status string, citations array<struct<citation:string,source_name:string,source_type:string>>"
    cited = [("Admin Code § 27-2005", "City Code", "law")]
    rows = [(1, "answered", 1, "code", "law", "27-2005", ["Heat"], "heat is due", "answered", cited), (2, "answered", 2, "state", "guidance", "MDL", ["heat", "rent"], "rent", "refused", cited), (3, None, None, None, None, None, None, None, None, None)]
    got = {r["id"]: r["failures"] for r in answers.failed_expectations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [], 2: ["status", "citation_count", "source_name", "source_type", "citation", "term:heat"], 3: []}
    checks = spark.createDataFrame([("a", True, "g1"), ("a", True, "g1"), ("b", True, "g1"), ("b", False, "g1"), ("c", True, "g1"), ("c", True, "g2")], "run string, ok boolean, g string")
    assert sorted(map(tuple, answers.evaluation_run(checks, "run", "ok", "g").collect())) == [("a", 2, 2, True, False), ("b", 2, 1, False, False), ("c", 2, 2, False, True)]
    first = answers.report_digest(checks, "run", "ok", "g").collect()
    again = answers.report_digest(checks.repartition(5).orderBy(F.desc("run")), "run", "ok", "g").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len({r["digest"] for r in first}) == 3


def test_checked_vectors(spark):
    import struct

    raw = struct.pack("<2f", 0.6, 0.8)
    bad = struct.pack("<2f", float("nan"), 1)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(0, raw, 2, "float32-le", True, digest(raw)), (1, raw, 2, "float32-le", False, digest(raw)), (2, raw, 2, "f8", True, digest(raw)), (3, raw[:4], 2, "float32-le", True, digest(raw)), (4, raw, 2, "float32-le", True, "x"), (5, bad, 2, "float32-le", True, digest(bad)), (6, None, 2, "float32-le", True, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), *r) for i, b, *r in rows], "id int, vector_bytes binary, dimension int, dtype string, normalized boolean, checksum string")
    got = {r["id"]: (r["fault"], r["vector"]) for r in documents.checked_vectors(df, 2).collect()}
    assert got[0] == (None, [pytest.approx(0.6), pytest.approx(0.8)]) and [got[i][0] for i in range(1, 7)] == ["not_normalized", "dtype", "dimension", "checksum", "not_finite", "dimension"]


def test_sections_of_a_range_from_archives(spark):
    import io
    import zipfile

    level = lambda n, text: f'<LEVEL style-name="Section"><RECORD><HEADING>§ {n} Title {n}.</HEADING></RECORD><PARA>{text}</PARA></LEVEL>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.xml", f"<DOC>{level('26-501', 'short')}{level('26-520.1', 'beyond')}{level('26-501.2', 'two')}</DOC>")
        z.writestr("b.XML", f"<DOC>{level('26-501', 'a longer text')}{level('26-520', 'last')}{level('27-1', 'other')}</DOC>")
        z.writestr("broken.xml", "<DOC>")
    archive = spark.createDataFrame([(bytearray(buffer.getvalue()),)], "c binary")
    assert [tuple(r) for r in documents.archive_range(archive, "c", "26-501", "26-520").collect()] == [("26-501", "Title 26-501.", "a longer text"), ("26-501.2", "Title 26-501.2.", "two"), ("26-520", "Title 26-520.", "last")]


def test_shown_changes(spark):
    rows = spark.createDataFrame([("b", "added"), ("a", "removed"), ("c", "unchanged")], "k string, classification string")
    assert [r["k"] for r in compare.shown(rows, "k").collect()] == ["a", "b"] and [r["k"] for r in compare.shown(rows, "k", ["added", "unchanged"], False).collect()] == ["b", "c"]
