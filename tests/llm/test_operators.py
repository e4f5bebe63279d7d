"""Each operator against a plain version of it, on texts made to be awkward."""

import hashlib
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, encoding, language_id, mixing, near_dedup, pii, quality_model, quality_rules, secret_scan, token_counts, token_output
from corpusmill.llm.components import components
from corpusmill.llm.encoding import Encoder

RNG = random.Random(11)
WORDS = ["the", "of", "anden", "ünd", "naïve", "Straße", "😀", "a", "token", "12", "x.y", "###", "ZEIT", "ñandú", "heitkeit"]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, rng=RNG):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", ". "]) for _ in range(n))


REPEATED = "one two three four five six seven eight nine ten.\n" * 12
TEXTS = [None, "", " ", "\n\n", "  ", "word", "😀" * 5, prose(30), prose(400), REPEATED, prose(50) + REPEATED, "x" * 50_000, prose(6000), prose(30)]
TEXTS += [TEXTS[8], TEXTS[8], TEXTS[8] + " more"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, repeated rows, and extra columns whose names clash with those that operators make up."""
    rows = [(i, t, ["de", "en", None][i % 3], ["a", "b", None, "ä"][i % 4], i, f"k{i}", i * 2) for i, t in enumerate(TEXTS)]
    rows += [(None, prose(40), "de", "a", None, None, None), (3, TEXTS[3], "de", "a", 3, "again", 0), (3, TEXTS[3], "de", "a", 3, "again", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, kept int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_no_operator_fails_on_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        quality_model.classify_quality(empty, labels), pii.personal_data(empty), token_counts.length_histogram(token_counts.encoded_lengths(empty)),
        quality_rules.quality_rules(empty), language_id.identify_languages(empty), token_output.tokenized(empty), decontamination.contaminated(empty, items),
        near_dedup.near_duplicates(empty), secret_scan.digest(secret_scan.scan_secrets(empty)), mixing.mix_sources(empty),
        quality_rules.keep_good(empty), near_dedup.one_of_each(empty), decontamination.clean_documents(empty, items), mixing.mixed_documents(empty),
    ):
        assert df.count() == 0


def test_quality_model(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.classify_quality(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)


def test_quality_model_learns_and_scores_by_adding_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    row = x[5:6]
    total = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, row[0]))
    total += sum(t[np.searchsorted(model.pair_edges[a], row[0, a], side="right"), np.searchsorted(model.pair_edges[b], row[0, b], side="right")] for a, b, t in model.pairs)
    assert model.score(row)[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality_model.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def base_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum((int(c) * (1 + i % 2) - 1) % 9 + 1 if int(c) else 0 for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in string.digits for c in m[0]) <= 15]
    return sorted(out)


def test_personal_data_base_spans_equal_the_patterns():
    pieces = ["a", "B", "7", "0", "255", ".", ".", "@", "-", " ", "+", "(", "_", "é", "😀", "٣", "ex.com", "+1 (555) 123-4567", "4111 1111 1111 1111", "10.0.0.1", "a@b.c", "\n"]
    for _ in range(20_000):
        t = "".join(RNG.choice(pieces) for _ in range(RNG.randint(0, 25)))
        assert [s for s in pii.spans(t) if s[0] < 4] == base_pii(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to bob (at) example (dot) com now", "email_text", "bob (at) example (dot) com"),
        ("see ftp://me:pw@host.org/x", "url_user", "ftp://me:pw@host.org"),
        ("lives at 12 Old Mill Street, x", "address", "12 Old Mill Street"),
        ("IBAN DE89 3704 0044 0532 0130 00 ok", "account", "DE89 3704 0044 0532 0130 00"),
        ("SSN: 123-45-6789", "account", "123-45-6789"),
    ],
)
def test_personal_data_further_kinds(text, kind, found):
    assert (kind, found) in [(pii.KINDS[k], text[a:z]) for k, a, z in pii.spans(text)]


def test_personal_data_leaves_clean_text_alone(docs):
    assert pii.spans("IBAN DE88 3704 0044 0532 0130 00 on account of 12 at the Street") == []
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count() and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)


def test_token_counts(spark, docs):
    encode = Encoder()
    sizes = [len(encode._whole([t or ""])[0]) // 4 for _, t in texts_of(docs)]
    rows = {r["length"]: r for r in token_counts.length_histogram(token_counts.encoded_lengths(docs)).collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(sizes)
    for k, r in rows.items():
        assert r["docs_at_least"] == sum(s >= k for s in sizes) and r["tokens_at_least"] == sum(s for s in sizes if s >= k)
        assert r["truncated_total"] == sum(min(s, k) for s in sizes) and r["total"] == sum(sizes)
        assert r["share_at_most"] == pytest.approx(sum(s <= k for s in sizes) / len(sizes))
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(docs))
    assert {r["limit"]: r["tokens"] for r in token_counts.truncated_total(histogram, [3, 77]).collect()} == {m: sum(min(s, m) for s in sizes) for m in (3, 77)}
    assert token_counts.quantiles(histogram, [0.5]).first()["length"] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]


def plain_rules(t):
    t = t or ""
    words = SPACE.findall(t)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen = 0, set()
    for line in t.split("\n"):
        if SPACE.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), lines, len(inside)


def test_quality_rules(docs):
    rows = quality_rules.quality_rules(docs).collect()
    want = [plain_rules(t) for _, t in texts_of(docs)]
    assert [tuple(r)[1:6] for r in rows] == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert any(r["kept"] for r in rows)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs).count() == sum(r["kept"] for r in rows)


def test_quality_rules_do_not_depend_on_what_shares_a_batch():
    texts = [prose(RNG.randint(0, 60), random.Random(i)) for i in range(300)] + [REPEATED]
    together = quality_rules.measure(texts)
    for i in range(0, 301, 25):
        alone = quality_rules.measure([texts[i]])
        assert all(together[k][i] == alone[k][0] for k in alone)


def test_equal_hashes_of_different_windows_are_told_apart():
    ids, doc = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3]), np.zeros(9, dtype=int)
    found = quality_rules._repeated(np.zeros(3, dtype=np.uint64), np.array([0, 3, 6]), ids, doc, 3)
    assert found.tolist() == [0, 6]


def test_language_id(spark):
    rng = random.Random(2)
    make = {"de": ["heit", "keit", "sch", "ung", "über"], "en": ["the", "ing", "tion", "wh", "th"], "ru": ["при", "вет", "сто", "ние", "ова"]}
    rows = [(i, " ".join("".join(rng.choice(make[lang]) for _ in range(3)) for _ in range(30)), lang) for i in range(300) for lang in [list(make)[i % 3]]]
    rows += [(1000, None, "de"), (1001, "", "de"), (1002, "123 !!", "en"), (None, rows[0][1], None)]
    got = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [(r, row) for r, row in zip(got, rows) if r["held_out"] and row[0] is not None and row[0] < 1000]
    assert sum(r["lang_pred"] == row[2] for r, row in held) / len(held) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"} and by_id[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_bundles_are_sums_of_bound_letters():
    text = "Abba ca"
    v = {c: language_id.letter_vector(ord(c) if c != "_" else 0) for c in "abc_"}
    bind = lambda g: np.roll(v[g[0]], 2) * np.roll(v[g[1]], 1) * v[g[2]]
    want = sum(bind(g) for g in ("_ab", "abb", "bba", "ba_", "_ca", "ca_"))
    assert np.allclose(language_id.bundles([text])[0], want)
    old, language_id.BLOCK = language_id.BLOCK, 2
    try:
        assert np.allclose(language_id.bundles([text, "", "abc"])[0], want)
    finally:
        language_id.BLOCK = old


def test_encoder_equals_the_tokenizer_on_whole_texts():
    pieces = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "The", "é", "😀", "1", "23", "'s", '"', "...", "\x1c", "\x85", "<|endoftext|>", "###", "don't", "\r\n", "x" * 70]
    encode = Encoder()
    for _ in range(60):
        texts = ["".join(RNG.choice(pieces) for _ in range(RNG.randint(0, 40))) for _ in range(40)]
        assert encode.encode(texts) == encode._whole(texts)


def test_encoder_that_forgets_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(encoding, "TRIED", 8)
    monkeypatch.setattr(encoding, "STEADY", 4)
    rng, encode = random.Random(5), Encoder()
    words = [*WORDS, "", "\n", "x\n", " ", "<|endoftext|>", "w" * 200]
    for _ in range(200):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 3))]
        assert encode.encode(texts) == encode._whole(texts)
        assert max(map(len, encode.tried)) <= encoding.LONG
    encode._forget()
    assert len(encode.tried) <= 8 and len(encode.steady) <= 4


def test_encoder_takes_each_different_piece_once(monkeypatch):
    """Words that differ in their punctuation only, in one step or in several, ask the model for no more than their pieces."""
    encode, asked = Encoder(), []
    by_model = encode._by_model
    monkeypatch.setattr(encode, "_by_model", lambda pieces: asked.extend(pieces) or by_model(pieces))
    texts = [f"{a} Die{b} Straße{c}{a}\nDie{c}" for a in ("", ".", ",", "!!") for b in (".", "$$$", "'s") for c in (".", " ", "\n")]
    for _ in range(2):
        for part in (texts[:20], texts[20:], texts):
            assert encode.encode(part) == encode._whole(part)
    assert len(asked) == len(set(asked)) <= 25
    assert [bytes(x) for x in encode.encode([])] == [] and encode.encode(["", "", "<|endoftext|>"]) == encode._whole(["", "", "<|endoftext|>"])


def test_encoder_cuts_as_the_pre_tokenizer_does():
    rng, encode = random.Random(11), Encoder()
    parts = [" ", "  ", "\n", "\t", "\xa0", "\u3000", "\x1c", "'s", "'ll", "'S", "'", "''s", "'re've", "\u2019s", "re", "7", "²", "Ⅷ", "_", "é", "漢字", "हिन्दी", "\u0301", "😀", "\0", "<|endoftext|>"]
    characters = [chr(x) for x in (*range(0x300), *rng.sample([*range(0x300, 0xD800), *range(0xE000, 0x110000)], 2000))]
    for pool in (parts, characters):
        for _ in range(100):
            texts = pa.array([None, *("".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(30))]).slice(rng.randint(0, 3))
            assert encode.encode_column(texts).to_pylist() == encode._whole([t or "" for t in texts.to_pylist()], encode.kind)


def test_encoding_by_pieces_costs_less_than_the_tokenizer_alone():
    """Words that come back with other punctuation cost little: word by word this took nine tenths of the tokenizer's time."""
    rng = random.Random(7)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "é", "er", "on")]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(30_000)]
    texts = ["".join(f" {rng.choice(words)}{rng.choice(('', '', '', '.', ',', '!!', '.\nDie', '$$$'))}" for _ in range(500)) for _ in range(400)]
    shares = []
    for _ in range(3):
        encode, clock = Encoder(), [time.process_time()]
        for run in (encode._whole, encode.encode):
            run(texts)
            clock.append(time.process_time())
        shares.append((clock[2] - clock[1]) / (clock[1] - clock[0]))
    assert min(shares) < 0.7


def test_steps_are_of_bytes_and_split_no_text(monkeypatch):
    monkeypatch.setattr(encoding, "STEP_BYTES", 10)
    texts = ["é" * 4, "a", "b", "c" * 50, "", None, "d" * 10, "e"]
    assert list(encoding.steps(pa.array(texts))) == [(0, 3), (3, 4), (4, 7), (7, 8)]


def test_token_output(docs):
    rows = token_output.tokenized(docs).collect()
    encode, want, at = Encoder(), [], 0
    order = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, t in order:
        ids = encode._whole([t or ""])[0] + b"\0\0\0\0"
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files_on_other_stores(tmp_path):
    from pyarrow import fs

    store, path = token_output.store_of("s3a://bucket/a/b", {"region": "us-east-1", "access_key": "k", "secret_key": "s"})
    assert isinstance(store, fs.S3FileSystem) and path == "bucket/a/b"
    assert token_output.store_of(f"file://{tmp_path}/x", {})[1] == token_output.store_of(f"{tmp_path}/x", {})[1] == f"{tmp_path}/x"
    np.arange(100, dtype="<u2").tofile(tmp_path / "x")
    there = token_output._Numbers(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "x", "<u2")  # one that can't be mapped
    assert there.mapped is None and there.length == 100 and there.read(7, 10).tolist() == [7, 8, 9]


def test_ranges_follow_the_order_and_split_a_repeated_id(spark):
    rows = spark.range(0, 20_000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000)) - 20_000).alias("doc_id"), F.lit("same text").alias("text"))
    n, out = token_output.encoded(rows, "text", "doc_id", None, 16)
    placed = out.select("range", "doc_id", "tie", "row").collect()
    order = sorted(placed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"], r["row"]))
    assert n == 16 and [r["range"] for r in order] == sorted(r["range"] for r in placed)
    assert max(Counter(r["range"] for r in placed).values()) < 3 * 20_000 / 16 and len({r["range"] for r in placed if r["doc_id"] is None}) >= 5


def test_many_bounds_cost_little():
    """Places compare as rows of (id given, id, tie, row) do, and a step finds its ranges among very many bounds at once."""
    rng = np.random.default_rng(3)
    draw = lambda n: [pa.array(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)) for _ in range(3)]
    few = [pa.array([None, -5, 3, 3, 3, -(1 << 63), (1 << 63) - 1, 0]), pa.array([1, 2, -7, 0, 0, 0, 0, 0]), pa.array([0, 0, 0, -256, 256, 0, 0, 0])]
    plain = sorted(zip(*(c.to_pylist() for c in few), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    order = np.argsort(token_output.packed(*few), kind="stable")
    assert [tuple(c[int(i)].as_py() for c in few) for i in order] == plain
    bounds = np.sort(token_output.packed(*draw(400_000)))
    rows = draw(1000)
    start = time.perf_counter()
    for _ in range(20):
        got = token_output._range_of(bounds, *rows)
    assert (time.perf_counter() - start) / 20 < 0.02
    assert (got == [int((bounds <= k).sum()) for k in token_output.packed(*rows)][:1000]).all()


def test_token_output_reads_long_documents_in_steps(spark, docs, monkeypatch):
    want = sorted(map(tuple, token_output.tokenized(docs).collect()), key=str)
    monkeypatch.setattr(token_output, "READ_IDS", 50)
    assert sorted(map(tuple, token_output.tokenized(docs.repartition(5)).collect()), key=str) == want


def plain_components(fps, radius=4):
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[root(a)] = root(b)
    groups = {}
    for x in fps:
        groups.setdefault(root(x), set()).add(x)
    return list(groups.values())


def test_fingerprint_is_the_majority_of_all_shingles():
    import xxhash

    for t in ["Ä Bc", "one Two three FOUR", prose(50), "a a a a a a a a"]:
        words = SPACE.findall("".join(c.lower() if c in string.ascii_uppercase else c for c in t))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert near_dedup.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_dedup.fingerprint(None) == near_dedup.fingerprint(" \n") == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_links_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(8)
    fps = {0, 2**64 - 1, *(rng.getrandbits(64) for _ in range(60))}
    for x in list(fps)[:25]:
        for _ in range(rng.randint(1, 30)):
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    found = components(near_dedup.links(df)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"] % 2**64)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in plain_components(sorted(fps)) if len(g) > 1)


def test_long_chains_are_one_component(spark):
    chain = spark.range(1500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain.unionByName(chain)).agg(F.max("root"), F.count("*")).first()[:] == (0, 1501)


def test_near_duplicates(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    groups = plain_components(sorted({r["fp"] % 2**64 for r in rows}))
    ids = [{r["doc_id"] for r in rows if r["fp"] % 2**64 in g and r["doc_id"] is not None} for g in groups]
    for r in rows:
        mine = next(i for i, g in zip(ids, groups) if r["fp"] % 2**64 in g)
        assert r["component_id"] == (min(mine) if mine else None)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min(i) if i else None for i in ids)


def base_secrets(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secret_scan(spark):
    rng = random.Random(3)
    token = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    hexa, b64 = "0123456789abcdef", string.ascii_letters + string.digits
    words = ["brown", "fox", "é", "😀", "PassWord=", "api_key : ", 'token="', "token=secret:abcdefghijklmnop", token(16, hexa), token(40, hexa), "my_file_name-version2/path/to_some-thing", "AKIA" + token(16, string.ascii_uppercase)]
    texts = [None, "", 'token = "abc'] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    secrets = [token(40, b64) + "7" for _ in range(20)]
    texts += [f"text before {s} and after" for s in secrets]
    rows = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert [tuple(x) for x in r["base"]] == base_secrets(texts[r["doc_id"]] or "")
        assert set(r["base"]) <= set(r["found"])
        for x in r["found"]:
            assert x["kind"] < 3 or "my_file" not in texts[r["doc_id"]][x["start"] : x["end"]]
    more = sum(any(x["kind"] >= 3 and texts[r["doc_id"]][x["start"] : x["end"]] in secrets for x in r["found"]) for r in rows)
    assert more >= 15
    digest = secret_scan.digest(secret_scan.scan_secrets(spark.createDataFrame([(1, texts[-1]), (1, texts[-1]), (None, None)], "doc_id long, text string"))).collect()
    assert len(digest) == 3 and {r["base_sha256"] for r in digest} == {hashlib.sha256(b"").hexdigest()}


def test_tokens_of_letters_only_are_tested(spark):
    """What the battery tests isn't narrowed beforehand: a random token may lack digits."""
    rng = random.Random(31)
    tokens = ["".join(rng.choice(al) for _ in range(n)) for al, n in (((string.ascii_letters, 48), (string.ascii_uppercase, 40), (string.digits * 3 + "abcdef", 15)) * 10)]
    rows = [(i, f"before {t} after") for i, t in enumerate([*tokens, "internationalization", "INTERNATIONALIZATIONS", "=" * 30, "-" * 40, "a" * 40])]
    got = {r["doc_id"]: r["found"] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    letters = [i for i in range(30) if i % 3 == 0]
    added = {i: [x for x in found if x["kind"] >= 3] for i, found in got.items()}
    assert sum(bool(added[i]) for i in letters) >= 6 and not any(added[i] for i in range(30, 35))


def test_secret_scan_runs_no_python(docs):
    plan = secret_scan.digest(secret_scan.scan_secrets(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_mix(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= 3 * sizes[s]
        free -= over
    return sizes, target


def test_mix_sources(docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    sizes, target = plain_mix(rows)
    got = mixing.mix_sources(docs)
    again = sorted(map(str, mixing.mix_sources(docs.repartition(7)).select("doc_id", "size", "taken").collect()))
    assert sorted(map(str, got.select("doc_id", "size", "taken").collect())) == again
    taken = Counter()
    for r in got.collect():
        s = r["_source"][1:] if r["_source"] else None
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in sizes)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(SPACE.findall(r["text"] or ""))
    longest = max(len(SPACE.findall(t or "")) for _, t, _ in rows)
    assert all(abs(words[s] - target[s]) <= longest / 2 + 1 for s in sizes)


def test_pipeline_stages_on_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline

    folder = tmp_path / "sf"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose(30).split()))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(folder))
        assert step.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(folder)).count() == step.count()
