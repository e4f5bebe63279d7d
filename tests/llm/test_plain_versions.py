"""Operators that SQL can't express, against plain versions that take nothing from the package but what is tested."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id, near_dedup, pii, quality_model, secret_scan
from corpusmill.llm.components import components

from test_operators import docs, plain_components, plain_mix  # noqa: F401  the fixture of awkward rows

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


# --- 1: quality model


def plain_fit(x, y, rounds, pair_rounds, n_pairs, n_bins, n_coarse, rate):
    """Cyclic boosting by loops: trees of three greedy cuts per feature, then quadrant cuts of the pairs with most gain."""
    n, k = x.shape
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1]).tolist())) for f in range(k)]
    coarse = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, n_coarse + 1)[1:-1]).tolist())) for f in range(k)]
    place = lambda cuts, v: sum(c <= v for c in cuts)
    bins = [[place(edges[f], v) for v in x[:, f]] for f in range(k)]
    wide = [[place(coarse[f], v) for v in x[:, f]] for f in range(k)]
    prior = (sum(y) + 0.5) / (n + 1)
    total = [math.log(prior / (1 - prior))] * n
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            gb, hb = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for b, u, v in zip(bins[f], g, h):
                gb[b] += u
                hb[b] += v
            cuts = [0, len(gb)]
            for _ in range(3):
                best, where = 1e-9, None
                for a, z in zip(cuts, cuts[1:]):
                    for c in range(a + 1, z):
                        gl, hl, gr, hr = sum(gb[a:c]), sum(hb[a:c]), sum(gb[c:z]), sum(hb[c:z])
                        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                        if hl >= 2 and hr >= 2 and gain > best + 1e-12:
                            best, where = gain, c
                if where is None:
                    break
                cuts = sorted([*cuts, where])
            for a, z in zip(cuts, cuts[1:]):
                step = rate * sum(gb[a:z]) / (sum(hb[a:z]) + 1)
                for b in range(a, z):
                    tables[f][b] += step
                total = [t + step if a <= b < z else t for t, b in zip(total, bins[f])]

    def quadrants(a, b, g, h):
        best = None
        for i in range(1, n_coarse):
            for j in range(1, n_coarse):
                sums = defaultdict(lambda: [0.0, 0.0])
                for u, v, p, q in zip(wide[a], wide[b], g, h):
                    sums[u >= i, v >= j][0] += p
                    sums[u >= i, v >= j][1] += q
                gain = sum(p * p / (q + 1) for p, q in sums.values())
                if best is None or gain > best[0] + 1e-12:
                    best = gain, i, j, {key: p / (q + 1) for key, (p, q) in sums.items()}
        return best

    g, h = slopes()
    chosen = sorted(((quadrants(a, b, g, h)[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)[:n_pairs]
    for _ in range(pair_rounds):
        for _, a, b in chosen:
            _, i, j, value = quadrants(a, b, *slopes())
            total = [t + rate * value[u >= i, v >= j] for t, u, v in zip(total, wide[a], wide[b])]
    return [1 / (1 + math.exp(-t)) for t in total]


def test_quality_model_fits_like_a_plain_loop(monkeypatch):
    for name, value in (("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2), ("BINS", 12), ("PAIR_BINS", 5)):
        monkeypatch.setattr(quality_model, name, value)
    rng = np.random.default_rng(3)
    x = rng.random((160, 3)).round(2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6)).astype(float)
    y[rng.random(160) < 0.1] = 1
    want = plain_fit(x, y.tolist(), 4, 3, 2, 12, 5, quality_model.RATE)
    assert np.allclose(quality_model.fit(x, y).score(x), want, atol=1e-9)


def test_quality_model_on_documents_held_out(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("the data folder isn't here")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_model.classify_quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in scored if r["quality"] == 1], [r["score"] for r in scored if r["quality"] == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert len(good) > 10 and len(bad) > 10 and wins / len(good) / len(bad) > 0.95


def test_repeated_rows_do_not_change_what_is_learned(spark):
    rows = spark.createDataFrame([(i, " ".join(["word"] * (i % 40 + 1)) + "!" * (i % 3)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    once = quality_model.learn(quality_model.document_features(rows), labels)
    twice = quality_model.learn(quality_model.document_features(rows.unionByName(rows)), labels.unionByName(labels))
    assert all(np.array_equal(a, b) for a, b in zip(once.tables, twice.tables)) and once.intercept == twice.intercept


# --- 2: personal data, the kinds that the method adds

LOCAL, SCHEME = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9+.-]"
STREETS = "Street Avenue Boulevard Road Lane Drive Square Court Place Way St Ave Blvd Rd Ln Dr Sq Ct Pl".split()
FORMS = "|".join(sorted({f for s in STREETS for f in (s, s.lower(), s.upper())}, key=len, reverse=True))


def iban(code):
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def added_kinds(t):
    out = []
    for m in re.finditer("://", t):
        rest = re.compile(r"[^\s/?#<>\"'@]+@[A-Za-z0-9.\[\]:-]+").match(t, m.end())
        starts = [s for s in range(m.start()) if re.fullmatch(rf"[A-Za-z]{SCHEME}*", t[s : m.start()])]
        if rest and starts:
            out.append(("url_user", starts[0], rest.end()))
    host = r" ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]+)+"
    out += [("email_text", *m.span()) for m in re.finditer(rf"{LOCAL}+ ?(?:\[at\]|\(at\)|\{{at\}}){host}", t)]
    low = 0
    for m in re.finditer(rf" (?P<cue>{FORMS})(?![^\W_])", t):
        capital, words, at = m["cue"][0].isupper(), 0, m.start()
        while n := re.compile(r".* ([^\W\d_][^\W\d_'.-]*(?:['.-]+[^\W\d_]*)*)\Z", re.S).match(t, low, at):
            if not (any(c.isupper() for c in n[1]) if capital else n[1].lower() not in pii.PROSE):
                break
            words, at = words + 1, n.start(1) - 1
        n = re.compile(r".*?((?<![^\W_])[1-9][0-9]*[A-Za-z]?)\Z", re.S).match(t, low, at)
        if words and n:
            out.append(("address", n.start(1), m.end()))
            low = m.end()
    number, at = re.compile(r"(?: ?(?:number|no\.?|num|nr\.?|#))?(?: ?[:#=]| is)? ?((?-i:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})|[0-9](?:[ -]?[0-9])+)", re.I | re.A), 0
    for m in re.finditer("(?=(" + "|".join(f for w in ("iban", "account", "acct", "ssn") for f in (w, w.capitalize(), w.upper())) + "))", t):
        end = m.end(1)
        if m.start() < at or (m.start() and t[m.start() - 1].isalnum()) or t[end : end + 1].isalpha() or not (n := number.match(t, end)):
            continue
        digits = re.sub("[ -]", "", n[1])
        if iban(n[1]) if n[1][0].isalpha() else len(digits) == 9 if m[1].lower() == "ssn" else m[1].lower() != "iban" and 6 <= len(digits) <= 17:
            at = n.end()
            out.append(("account", *n.span(1)))
    return sorted(out)


def test_added_kinds_equal_plain_ones():
    rng = random.Random(5)
    pieces = ["a", "Bo", " ", " ", ".", "://", "@", "x:y@h.org", "ftp", "[at]", " (at) ", "(dot)", " dot ", "host.com", "12", "7B", " Old", " Mill", " main", " the", " d'Or", " Street", " street", " lane", "0", "1234567", " St", " AVE", "é", "SSN", "iban ", "Account no. ", "acct#", "123-45-6789", "DE89 3704 0044 0532 0130 00", "1234 5678", ":", "/", "\n", "+"]
    seen = Counter()
    for _ in range(15_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 18)))
        got = sorted((pii.KINDS[k], a, z) for k, a, z in pii.spans(t) if k >= 4)
        assert got == added_kinds(t), t
        seen.update(k for k, _, _ in got)
    assert len(seen) == 4 and min(seen.values()) > 50


def test_long_matches_of_added_kinds_are_whole():
    user = "u" * 400
    assert [(pii.KINDS[k], a, z) for k, a, z in pii.spans(f"see https://{user}:p@host.example.organisation/x") if k == 4] == [("url_user", 4, 4 + 8 + 403 + 26 - 1)] or pii.spans(f"https://{user}:p@host.example.organisation/x")[-1][2] == len(f"https://{user}:p@host.example.organisation")
    assert (7, 100 + 8, 100 + 8 + 9) in pii.spans("x" * 99 + " account 123456789")


# --- 5: languages


def plain_vectors(text):
    text = (text or "").lower()
    words = re.findall("[a-zäöüßñéïúó]+", text)
    out = np.zeros(1024)
    for w in words:
        codes = [0, *map(ord, w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            v = [np.random.default_rng((20_240_607, x)).integers(0, 2, 1024) * 2 - 1 for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def test_languages_equal_a_plain_prediction(spark, docs):  # noqa: F811
    rng = random.Random(2)
    make = {"de": ["heit", "keit", "sch", "ung", "über"], "en": ["the", "ing", "tion", "wh", "th"], "es": ["ción", "mente", "osa", "que", "ñas"]}
    extra = [(1000 + i, " ".join("".join(rng.choice(make[lang]) for _ in range(2)) for _ in range(rng.randint(1, 12))), lang) for i in range(60) for lang in [list(make)[i % 3]]]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.filter("length(text) < 2000 OR text IS NULL").collect()] + extra
    known = defaultdict(lambda: np.zeros(1024))
    for i, t, lang in rows:
        if not held_out(i) and lang is not None and t is not None:
            known[lang] += plain_vectors(t)
    known = {k: v / np.linalg.norm(v) for k, v in known.items() if v.any()}
    got = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(got, rows):
        v = plain_vectors(t)
        scores = {k: float(v @ p) for k, p in known.items()}
        assert r["held_out"] == held_out(i)
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert r["score"] == pytest.approx(max(scores.values()), abs=1e-4) and scores[r["lang_pred"]] == pytest.approx(max(scores.values()), abs=1e-4)


# --- 8: more blocks for more fingerprints


@pytest.mark.parametrize("n", [5_000_000, 2_000_000_000])
def test_links_are_exact_for_every_number_of_blocks(spark, monkeypatch, n):
    masks = near_dedup._tables(n)
    assert len(masks) == {5_000_000: 15, 2_000_000_000: 35}[n]
    monkeypatch.setattr(near_dedup, "_tables", lambda _: masks)
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:20]:
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    groups = defaultdict(set)
    for r in components(near_dedup.links(df)).collect():
        groups[r["root"]].add(r["node"] % 2**64)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in plain_components(sorted(fps)) if len(g) > 1)


# --- 9: the battery of tests

ALPHABETS = {
    "random_hex": ("0123456789abcdef", 0.8), "random_base32": (string.ascii_uppercase + "234567", 1.0), "random_base62": (string.ascii_uppercase + string.ascii_lowercase + string.digits, 1.2),
    "random_base64": (string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", 1.2), "random_url64": (string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_", 1.2),
}
KINDS = ["assign", "access", "hex", *ALPHABETS]
phi = lambda z: math.erfc(-z / math.sqrt(2)) / 2


def battery(token):
    """Kind, length class, p-value of unevenness, and the least p-value of the runs and serial tests; None for no encoding."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        kind = "random_hex"
        token = token.lower()
    else:
        kind = next((k for k in list(ALPHABETS)[1:] if set(token) <= set(ALPHABETS[k][0])), None)
    if kind is None:
        return None
    alphabet, uneven = ALPHABETS[kind]
    k, n = len(alphabet), len(token)
    chi = k / n * sum(c * c for c in Counter(token).values()) - n
    p = phi((chi - (k - 1 + n * uneven)) / math.sqrt(2 * (k - 1 + 2 * n * uneven)))
    v = [alphabet.index(c) for c in token]
    high = [x >= k / 2 for x in v]
    up, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs_z = (runs - mean) / math.sqrt(var) if var > 0 else 12
    level = sum(v) / n
    spread = sum((x - level) ** 2 for x in v)
    serial_z = (sum((a - level) * (b - level) for a, b in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n) if spread else 12
    return kind, sum(n >= x for x in (24, 32, 48, 96)), p, min(2 * phi(-abs(runs_z)), 2 * phi(-abs(serial_z)))


def test_secret_scan_equals_a_plain_battery(spark, docs):  # noqa: F811
    rng = random.Random(13)
    token = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    words = ["brown", "fox", "my_file_name-version2/path/to_some-thing", "aaaaaaaaaaaaaaaa1aaaa", "password=abcdefghijkl12", "Version20240101Final2", "é😀"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(150):
        al, _ = rng.choice(list(ALPHABETS.values()))
        rows.append((2000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) + " " + token(rng.choice((16, 20, 28, 40, 64, 120)), al) + rng.choice([" end", "", ", " + token(30, ALPHABETS["random_hex"][0])])))
    pattern = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
    tested, counts = [], defaultdict(Counter)
    for at, (_, t) in enumerate(rows):
        for m in pattern.finditer(t or ""):
            if got := battery(m[0]):
                kind, size, p, least = got
                bin_ = min(800, math.floor(-math.log10(max(p, 1e-300)) * 20)) if least >= 0.001 else -1
                counts[size][bin_] += 1
                tested.append((at, m.start(), m.end(), kind, size, bin_))
    passing = {}
    for size, bins in counts.items():
        total, rank = sum(bins.values()), 0
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            rank += bins[b]
            if 10 ** (-b / 20) <= 0.05 * rank / total:
                passing[size] = b
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = defaultdict(set)
    for at, a, z, kind, size, b in tested:
        if b >= passing.get(size, 999) and not any(x["start"] < z and a < x["end"] for x in got[at]["base"]):
            want[at].add((kind, a, z))
    found = {at: {(KINDS[x["kind"]], x["start"], x["end"]) for x in r["found"] if x["kind"] >= 3} for at, r in enumerate(got)}
    assert {at: s for at, s in found.items() if s} == dict(want) and sum(map(len, want.values())) > 40


# --- the pipeline


def plain_good(t):
    """The verdict of the quality rules, by counting."""
    words = SPACE.findall(t or "")
    if len(words) < 20:
        return False
    chars = sum(map(len, words))

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    lines, again = Counter(), 0
    for line in (t or "").split("\n"):
        held = SPACE.findall(line)
        again += sum(map(len, held)) if held and lines[line] else 0
        lines[line] += 1
    if 100 * len(covered(8)) > 30 * len(words) or again / chars > 0.30:
        return False
    return all(sum(len(words[j]) for j in covered(n)) / chars <= most for n, most in ((5, 0.40), (8, 0.35), (12, 0.30)))


def plain_near_copies(rows):
    """The row of the least id of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    def shingles(t):
        ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in SPACE.findall(t or "")]
        return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])

    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_mixed(rows):
    """The rows as often as the mix takes them: whole, the one that a budget ends in if at least half of it fits."""
    sizes, target = plain_mix([(i, t, s) for i, t, s in rows])
    out = []
    for source in sizes:
        mine = [(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, len(SPACE.findall(t or "")), i, t) for i, t, s in rows if s == source]
        whole, before = int(target[source] + 1e-9), 0
        epochs = whole // sizes[source] if sizes[source] else 0
        for _, _, size, i, t in sorted(mine, key=lambda m: m[:3]):
            room = whole - epochs * sizes[source] - before
            before += size
            out += [(i, t)] * (epochs + (2 * room >= size)) if size else []
    return out


def test_pipeline_equals_plain_stages_to_the_end(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    leak = text(30)
    rows = [(i, text(rng.randint(5, 120)), rng.choice(["a", "b", None, "ä"])) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1] + " tail", "b") for i in range(12)]
    rows += [(200, f"{text(40)} {leak} {text(5)}", "a"), (201, "same line here\n" * 30 + text(20), "a"), (202, None, "a"), (203, "", "b"), (None, text(50), None)]
    rng.shuffle(rows)
    folder = tmp_path / "sf"
    spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = [r for r in plain_near_copies([r for r in rows if plain_good(r[1])]) if leak not in (r[1] or "")]
    assert 30 < len(kept) < 60
    tokenizer, want, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, t in sorted(plain_mixed(kept), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(folder)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
