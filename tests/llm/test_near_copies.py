"""The pipeline's near-copy stage against a plain comparison of all pairs of texts."""

import random
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from corpusmill.llm import near_copies, near_dedup


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_leads(rows):
    """The least id of each component of pairs with five-word Jaccard of 0.8 or more."""
    sets, label = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if not (a or sets[j]) or Fraction(len(a & sets[j]), len(a | sets[j])) >= Fraction(4, 5):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for (d, _), x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append((d is None, d or 0))
    return Counter(None if none else d for none, d in map(min, groups.values()))


def texts(rng):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([3, 5, 40, 120, 400]))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    return [None, "", " \n", *rows]


@pytest.mark.parametrize("tile", [512, 2])
def test_stage_drops_what_a_plain_comparison_drops(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(3)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, "only without an id once"), (None, "only without an id once")]
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"]
    assert Counter(r["doc_id"] for r in kept.collect()) == plain_leads(rows)


def test_stage_links_near_copies_whose_fingerprints_are_far_apart(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    other = list(base)
    for at in (30, 90):
        other[at] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:80]))]
    a, b = (plain_shingles(t) for _, t in rows[:2])
    assert len(a & b) / len(a | b) >= 0.8
    assert (near_dedup.fingerprint(rows[0][1]) ^ near_dedup.fingerprint(rows[1][1])).bit_count() > 4
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_stage_compares_what_fingerprints_link(spark, monkeypatch):
    """Without MinHash bands, texts with close fingerprints are still found, and are verified on their sets."""
    monkeypatch.setattr(near_copies, "band_keys", lambda held: near_copies.np.array([held.sum()] if len(held) else [], dtype="u8").view("i8"))
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(reversed(base)))]
    assert (near_dedup.fingerprint(rows[0][1]) ^ near_dedup.fingerprint(rows[1][1])).bit_count() <= 4
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_bands_miss_hardly_a_pair_at_the_threshold():
    rng, missed = random.Random(7), 0
    for _ in range(2000):
        a, b, both = ([rng.getrandbits(64) for _ in range(n)] for n in (10, 10, 80))  # similarity 0.8
        sketches = [set(near_copies.band_keys(near_copies.np.array(x + both, dtype="u8")).tolist()) for x in (a, b)]
        missed += not sketches[0] & sketches[1]
    assert missed == 0
