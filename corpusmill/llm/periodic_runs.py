"""Periodic runs: stretches of words that repeat with one period, found within repeated k-grams.

A run is a stretch of consecutive words with least period q and max(24, 3 * q) words or more that no neighbouring word
extends. Each of its words stands in a k-gram that recurs in the document q words on, where k is the least overlap of a
run with itself moved by its period: max(24 - q, 2 * q) is 16 or more for every q. So words outside repeated 16-grams
can't belong to a run. They are masked by rolling hashes, and what is left falls into segments, which hold all runs.

Main and Lorentz's divide and conquer finds the runs of the segments: a run belongs to the first centre that it crosses,
and there a pair of words one period apart, one of them at the centre, extends to both sides over the run's overlap. All
segments of a batch are searched at once, with a separator between them; extensions come from hashes by binary search,
and each run is compared word by word before it counts. The work per word grows with the logarithm of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, chunks, mixed, picked, portions

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 24, 3
#: Least overlap of a run with itself moved by its period, over all periods.
K = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST + 1))
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Prefixes:
    """Hashes of any stretch of a sequence of numbers; equal stretches have equal hashes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.power = np.full(n + 1, BASE)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        inverse = np.full(n + 1, np.uint64(pow(int(BASE), -1, 1 << 64)))
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(ids) * inverse[:n], out=sums[1:])
        self.n, self.sums = n, sums

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.power[start]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.of(a, a + length) == self.of(b, b + length)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the stretches from a and from b > a on are equal."""
        low, high = np.zeros(len(a), dtype=np.int64), self.n - b
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(a, b, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the stretches that end before a and before b > a are equal."""
        low, high = np.zeros(len(a), dtype=np.int64), a.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(a - middle, b - middle, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def surviving(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for the words that stand in a k-gram that its document holds twice or more."""
    n = len(ids)
    keep = np.zeros(n, dtype=bool)
    if n < K:
        return keep
    held = Prefixes(ids)
    start = np.flatnonzero(doc[: n - K + 1] == doc[K - 1 :])
    key = mixed(held.of(start, start + K) ^ mixed(doc[start]))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(start), dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[start[twice]] += 1
    np.subtract.at(edge, start[twice] + K, 1)
    return np.cumsum(edge[:n]) > 0


def _candidates(held: Prefixes, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """place, period, start and stop of pairs beside each centre of the divide and conquer whose surroundings agree over
    half of a run's overlap, to the right or to the left; from start to stop the sequence has that period."""
    size = LEAST
    while size < n:
        size *= 2
    while size >= LEAST:  # blocks of this size, each with its centre
        centre = np.arange(size // 2, n, size)
        most = size // TIMES  # a run that crosses no centre of larger blocks lies inside its block
        for part in np.array_split(centre, max(1, len(centre) * most >> 19)):
            for low in range(1, most + 1, 1 << 19):
                period = np.arange(low, min(low + (1 << 19), most + 1))
                at, p = np.repeat(part, len(period)), np.tile(period, len(part))
                for place in (at, at - p):
                    half = (np.maximum(LEAST - p, (TIMES - 1) * p) + 1) // 2
                    right = np.flatnonzero((place >= 0) & (place + p + half <= n))
                    right = right[held.same(place[right], place[right] + p[right], half[right])]
                    left = np.flatnonzero((place >= half) & (place + p <= n))
                    left = left[held.same(place[left] - half[left], place[left] + p[left] - half[left], half[left])]
                    start, stop = place.copy(), place + p
                    start[left] -= half[left]
                    stop[right] += half[right]
                    both = np.union1d(right, left)
                    if len(both):
                        yield place[both], p[both], start[both], stop[both]
        size //= 2


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    held = Prefixes(ids)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    owner = np.full(n, -1)  # a known run that holds the word
    periods: list[int] = []
    for some in _candidates(held, n):
        order, at, step = np.argsort(some[1], kind="stable"), 0, 64
        while at < len(order):  # short periods first: what lies in one of their runs has nothing new at a multiple
            place, period, low, high = (x[order[at : at + step]] for x in some)
            at, step = at + step, 2 * step
            of = owner[low]
            known = (of >= 0) & (of == owner[high - 1])
            known[known] = period[known] % np.array(periods, dtype=np.int64)[of[known]] == 0
            place, period = place[~known], period[~known]
            start = place - held.backward(place, place + period)
            stop = place + period + held.forward(place, place + period)
            long = stop - start >= np.maximum(LEAST, TIMES * period)
            for s, e, p, i in zip(*(x[long].tolist() for x in (start, stop, period, place)), strict=True):
                if p < found.get((s, e), (e - s + 1, 0))[0]:  # of the periods of one stretch the least counts
                    found[s, e] = p, i
                    owner[s:e] = len(periods)
                    periods.append(p)
    sure = {}
    for (s, e), (p, i) in found.items():
        if not (ids[s : e - p] == ids[s + p : e]).all():  # hashes agreed by chance: compare from the pair on
            apart = np.flatnonzero(ids[: n - p] != ids[p:])
            at = int(np.searchsorted(apart, i))
            s = int(apart[at - 1]) + 1 if at else 0
            e = (int(apart[at]) if at < len(apart) else n - p) + p
            if e - s < max(LEAST, TIMES * p):
                continue
        sure[s, e] = min(p, sure.get((s, e), p))
    return sorted((s, e - s, p) for (s, e), p in sure.items())


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, given by its words."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(ws) for ws in documents], dtype=np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in documents for w in ws), dtype=np.int64, count=int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    doc = np.repeat(np.arange(len(documents)), sizes)
    places = np.flatnonzero(surviving(ids, doc))
    if not len(places):
        return out
    first = np.concatenate([[True], (np.diff(places) > 1) | (np.diff(doc[places]) > 0)])
    segment = np.cumsum(first) - 1
    joined = np.full(len(places) + int(segment[-1]), -1, dtype=np.int64)
    joined[np.arange(len(places)) + segment] = ids[places]
    gaps = np.flatnonzero(joined < 0)
    joined[gaps] = len(numbers) + np.arange(len(gaps))  # each separator differs from every word
    begin = np.concatenate([[0], np.cumsum(sizes)])
    origin = places[first] - (np.arange(len(places)) + segment)[first]
    for s, length, p in runs(joined):
        at = s + int(origin[np.searchsorted(gaps, s)])
        of = int(doc[at])
        out[of].append((at - int(begin[of]), length, p))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by spaces."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, length, p in found:
        gone[s + p] += 1
        gone[s + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and collapsed, the text without repeated periods.

    Words are runs of anything but ASCII white space. Null and empty texts have no runs, and their collapsed text is
    empty. Null keys and repeated rows give a row each; an empty table gives an empty one. Other columns are left out.
    """
    rows = picked(docs, doc_id=F.col(key), text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for whole in portions(batches):
            texts = [t or b"" for t in whole.column(1).cast(pa.binary()).to_pylist()]
            for a, z in chunks(texts):
                words = [t.split() for t in texts[a:z]]
                found = runs_of(words)
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] for rows in found]
                left = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, z - a), pa.array(listed, kind), left.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs {RUN}, collapsed string")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text, where a tenth of the texts, by a hash h of the id, repeat from some word on.

    If h % 10 = 0 and there are n > 0 words, each word i >= a is word a + (i - a) % p, with g = h // 10, a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Their words are joined by spaces. A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def from_word(a: Column) -> Column:
            p = 1 + F.floor((n - a) / (3 + g % 8))
            return _let(p, lambda p: F.array_join(F.transform(words, lambda _, i: words[F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")]), " "))

        return F.when(n > 0, _let(g % F.greatest(n, F.lit(1)), from_word)).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), F.lit(0))
    return picked(docs, doc_id=F.col(key), text=F.when(h % 10 == 0, _let(words, repeated)).otherwise(F.col(text)))


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: n_runs; start, length, period and exponent_milli of the run with the greatest length
    over period (ties: least start, then period; nulls if there is none); hashes of the runs and of the collapsed text.
    """

    def better(best: Column, r: Column) -> Column:  # runs come by start, then period, so the first of equals stays
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
