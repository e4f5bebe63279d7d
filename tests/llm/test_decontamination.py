"""Benchmark decontamination against plain versions that share no code with it."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import decontamination as D


def tokens(t):
    """For the texts made here: lower-case runs of letters and digits; a Han character is a word."""
    return re.findall(r"[一-鿿]|[^\W_一-鿿]+", (t or "").lower())


def runs(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def held(item, document):
    """The overlap rule over a whole document."""
    ws, have = tokens(item), tokens(document)
    if len(ws) < 12:
        return bool(ws) and tuple(ws) in runs(have, len(ws))
    head, mark, tail = item.rpartition("?")
    n = len(tokens(head)) if mark and tokens(head) and tokens(tail) else (len(ws) + 1) // 2
    question, answer, have = runs(ws[: max(n, 5)], 5), runs(ws[min(n, len(ws) - 5) :], 5), runs(have, 5)
    return len(question & have) / len(question) + len(answer & have) / len(answer) >= 1


def zipf(rng, size):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(size)]
    weights = [1 / (i + 1) for i in range(size)]
    return lambda n: " ".join(rng.choices(words, weights, k=n))


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("chars", [8_000_000, 3_000])
def test_finds_what_a_plain_search_finds(spark, monkeypatch, chars):
    monkeypatch.setattr(D, "GROUP_CHARS", chars)
    if chars == 3_000:  # many groups, and a table of bits made in parts
        monkeypatch.setattr(D, "PART_BITS", 12)
    rng = random.Random(4)
    text = zipf(rng, 3000)
    items = [(i, text(rng.randint(12, 60)) + (f"? {text(rng.choice([1, 3, 6]))}" if i % 3 == 0 else "")) for i in range(40)]
    items += [(50 + i, text(n)) for i, n in enumerate((5, 7, 8, 11))] + [(60, "北京是中国的首都吗？是的，北京是中国的首都。"), (90, None), (91, ""), (None, text(20)), (0, None)]
    items.append(items[5])
    docs = [(i, text(rng.randint(0, 500))) for i in range(60)]
    docs += [(100 + i, f"{text(200)} {items[i][1].upper()}, {text(100)}") for i in range(44)]
    docs += [(200 + i, text(90) + "\n" + " ".join(items[i][1].split()[: len(items[i][1].split()) // 2 + 3])) for i in range(40)]
    docs += [(300, None), (301, ""), (302, "x" * 50_000), (303, "他说：北京是中国的首都吗？是的，北京是中国的首都。很好"), (None, items[7][1]), (107, docs[67][1])]
    documents, benchmark = frames(spark, docs, items)
    got = Counter((r["doc_id"], r["item_id"]) for r in D.contaminated(documents, benchmark).collect())
    want = Counter((d, i) for d, t in docs for i, s in dict.fromkeys(items) if s and held(s, t))
    assert {(100 + i, i) for i in range(40)} <= set(want) and (303, 60) in want and (None, 7) in want and (101 + 43, 50) not in want
    assert got == want
    clean = D.clean_documents(documents, benchmark)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, t in docs if not any(s and held(s, t) for _, s in items))


def test_halves_of_items_over_zipf_text_are_all_found(spark):
    """The threshold must not lose what the overlap rule would pass, however common an item's words are."""
    rng = random.Random(9)
    text = zipf(rng, 2000)
    items = [(i, text(rng.randint(12, 60))) for i in range(300)]
    docs = []
    for i, s in items:
        ws = s.split()
        cut = (len(ws) + 1) // 2
        for k, piece in enumerate((ws[:cut], ws[cut:], ws[: math.ceil(0.6 * len(ws))])):
            docs.append((3 * i + k, f"{text(rng.randint(0, 200))} {' '.join(piece)} {text(rng.randint(0, 200))}"))
    want = {(d, i) for (d, t), (i, s) in ((docs[3 * i + k], items[i]) for i in range(300) for k in range(3)) if held(s, t)}
    assert len(want) == 900
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(*frames(spark, docs, items)).select("doc_id", "item_id").collect()}
    assert want <= got and all(held(items[i][1], docs[d][1]) for d, i in got)


def keys_of(ws):
    """The keys of the runs of five words, in order."""
    return D.gram_keys(D.word_hashes((w.encode() for w in ws), len(ws)), 5).tolist()


def opened(items, n_parts=1):
    """An index of (id, words) in memory, with a table of bits that lets all through."""
    df = Counter(k for _, ws in items for k in set(keys_of(ws)))
    mean = sum(len(ws) - 4 for _, ws in items) / len(items)
    built = D.build([(i, " ".join(ws)) for i, ws in items], df, len(items), mean)
    lists = {"ids", "words"}
    return df, mean, [D.Index(**{k: D.pa.array(v) if k in lists else v for k, v in fields.items()}) for fields in built]


def test_wand_gives_the_scores_of_plain_bm25():
    rng = random.Random(6)
    stock = [zipf(rng, 300)(8).split() for _ in range(120)]  # phrases that items and documents share
    text = lambda n: [w for _ in range(n) for w in rng.choice(stock)]
    items = [(i, text(rng.randint(2, 4))) for i in range(200)]
    df, mean, (index,) = opened(items)
    documents = [text(12) for _ in range(40)] + [items[3][1], items[7][1][:9]]
    n_words = np.array([len(ws) for ws in documents])
    begin = np.cumsum(n_words) - n_words
    at = np.concatenate([np.arange(max(len(ws) - 4, 0)) + b for ws, b in zip(documents, begin, strict=True)])
    keys = np.array([k for ws in documents for k in keys_of(ws)], dtype=np.uint64)
    got = {(d, s, index.ids[i].as_py()): v * index.least[i] for d, s, i, v in D.search(n_words, at, keys, index)}
    want = {}
    for d, ws in enumerate(documents):
        for s in range(0, len(ws), 32):
            have = runs(ws[s : s + 64], 5)
            for i, item in items:
                counts = Counter(tuple(item[j : j + 5]) for j in range(len(item) - 4))
                number = dict(zip((tuple(item[j : j + 5]) for j in range(len(item) - 4)), keys_of(item), strict=True))
                impact = {g: math.log(1 + (200 - df[number[g]] + 0.5) / (df[number[g]] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(item) - 4) / mean)) for g, n in counts.items()}
                share = sum(x for g, x in impact.items() if g in have) / sum(impact.values())
                if share >= index.least[index.ids.to_pylist().index(i)] - 1e-5:
                    want[d, s, i] = share
    assert len(want) > 20 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_least_score_bounds_every_passage_that_passes():
    rng = random.Random(2)
    for _ in range(300):
        ws = [rng.choice("abcd") for _ in range(rng.randint(5, 25))]
        split, impact = rng.randint(1, len(ws) - 1), {g: rng.random() + 0.01 for g in runs(ws, 5)}
        least = D.least_score(ws, split, impact)
        a = rng.randint(0, len(ws))
        passage = ws[a : rng.randint(a, len(ws))] if rng.random() < 0.8 else ws
        if sum(D.overlaps(ws, split, passage)) >= 1:
            assert sum(impact[g] for g in runs(passage, 5)) >= least


def test_more_items_in_the_corpus_own_words_are_hardly_more_work(monkeypatch):
    """Items cut from other texts of one language: what reaches an index, and what WAND is asked, stay few as items grow."""
    rng = random.Random(12)
    text = zipf(rng, 1500)
    documents = [text(400) for _ in range(60)]
    asked = []
    plain = D.wand
    monkeypatch.setattr(D, "wand", lambda edge, terms, index: asked.append(len(edge) - 1) or plain(edge, terms, index))
    for n in (50, 1600):
        _, _, indexes = opened([(i, text(rng.randint(20, 60)).split()) for i in range(n)])
        bits = np.zeros(1 << 19, dtype=np.uint8)
        for index in indexes:
            slot = index.key >> np.uint64(64 - 22)
            np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), (1 << (slot & np.uint64(7))).astype(np.uint8))
        bench, asked[:] = D.Benchmark(bits, indexes), []
        assert not any(bench.leaks(documents))
        assert sum(asked) <= 3
        keys = np.concatenate([np.array(keys_of(t.split()), dtype=np.uint64) for t in documents])
        assert len(bench.may_have(keys)) < len(keys) * (0.02 if n == 50 else 0.1)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_clashing_columns_and_other_keys(spark, kind):
    rng = random.Random(8)
    text = zipf(rng, 900)
    items = [(i, text(30)) for i in range(5)]
    rows = [(f"{i}" if kind == "string" else i, f"{text(50)} {items[i % 5][1] if i % 2 else ''}", 1, 2.0, "x") for i in range(20)] + [(None, items[0][1], 1, 2.0, "x")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, item_id int, bm25 double, clean string")
    benchmark = spark.createDataFrame([(f"q{i}", t, "y", 3) for i, t in items], "item_id string, text string, item string, terms int")
    got = Counter((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, benchmark).collect())
    assert got == Counter((r[0], f"q{i}") for r in rows for i, s in items if held(s, r[1])) and len(got) > 9
    clean = D.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not any(held(s, r[1]) for _, s in items))


def test_words_of_scripts_without_spaces_and_other_punctuation():
    assert D.words("Ab—cd… ｅ，東京。Ünd") == [w.encode() for w in ("ab", "cd", "ｅ", "東", "京", "ünd")]
    assert D.words(None) == D.words(" ?") == []
