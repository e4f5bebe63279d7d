"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance, exactly.

Distinct fingerprints that are within the radius agree on some of the blocks that the 64 bits are cut into, so they
meet in a bucket of one of a few tables. Buckets are compared bit-sliced: the bits of 64 fingerprints stand in one
vertical word per bit position, carry-save counters add up 64 distances at a time, and a word is abandoned once all its
counters are over the radius. A large bucket is cut into tiles and pairs of tiles are compared, so no task holds more
than two tiles; each returns a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusmill.llm.common import by_portion, cut, fresh, picked
from corpusmill.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile.
TILE = 1024
#: (query, word of 64 lanes) pairs compared at a time.
PAIRS = 1 << 15
#: Bit positions between two looks at which words may be abandoned.
LOOK = 8
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the XXH64 of all shingles, as an unsigned integer; 0 if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :] or ends[-1:], strict=False)), dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    """The fingerprint's 64 bits as a signed integer."""
    return by_portion(texts, lambda part: np.array([fingerprint(t) for t in part], dtype=np.uint64).view(np.int64), pa.int64())


def _tables(n: int) -> list[int]:
    """Masks of the bits that the buckets of each table share.

    Of m blocks, RADIUS differing bits leave m - RADIUS untouched: each choice of so many blocks is a table. More rows
    mean more, longer keys, so that buckets stay small; any m gives the same links.
    """
    m = RADIUS + (1 if n <= 4_000_000 else 2 if n <= 1_000_000_000 else 3)
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(m)]
    return [sum(chosen) for chosen in combinations(blocks, m - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(lanes: np.ndarray) -> np.ndarray:
    """Rows of 64 fingerprints -> 64 rows of words: word [p, r] holds bit p of the 64 fingerprints of row r."""
    out = np.empty((64, len(lanes)), dtype=np.uint64)
    for at in range(0, len(lanes), 1024):
        bits = np.unpackbits(np.ascontiguousarray(lanes[at : at + 1024]).astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
        out[:, at : at + 1024] = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    return out


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of the linked nodes; label[x] is the least node of x's set before and after."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def forest(fps: np.ndarray, group: np.ndarray, is_query: np.ndarray, is_lane: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that connect what links within the groups. ``group`` ascends; ``mask`` holds bits known equal.

    Queries of a group are compared with its lanes. Where a row is both, only with its own word of lanes and later ones.
    """
    lane_rows = np.flatnonzero(is_lane)
    lane_group = group[lane_rows]
    first = np.concatenate([[True], lane_group[1:] != lane_group[:-1]]) if len(lane_rows) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    if not len(begin):
        return fps[:0], fps[:0]
    count = np.diff(np.append(begin, len(lane_rows)))
    n_words = -(-count // 64)
    word_base = np.cumsum(n_words) - n_words
    of = np.repeat(np.arange(len(begin)), count)
    slot = 64 * word_base[of] + np.arange(len(lane_rows)) - begin[of]
    node = np.full(64 * int(n_words.sum()), -1, dtype=np.int64)
    node[slot] = lane_rows
    node = node.reshape(-1, 64)
    lanes = np.where(node >= 0, fps[node], np.uint64(0))
    valid = np.packbits(node >= 0, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)
    planes = _planes(lanes)
    order = [p for p in range(64) if not mask >> p & 1]

    queries = np.flatnonzero(is_query)
    where = np.searchsorted(lane_group[begin], group[queries])
    known = (where < len(begin)) & (lane_group[begin[np.minimum(where, len(begin) - 1)]] == group[queries])
    queries, where = queries[known], where[known]
    own = np.zeros(len(fps), dtype=np.int64)
    own[lane_rows] = slot // 64 - word_base[of]
    skip = np.where(is_lane[queries], own[queries], 0)
    todo = n_words[where] - skip
    total = np.cumsum(todo)
    label = np.arange(len(fps))
    start = 0
    while start < len(queries):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, side="right")))
        reps = todo[start:stop]
        q = np.repeat(queries[start:stop], reps)
        word = np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(word_base[where[start:stop]] + skip[start:stop], reps)
        value = fps[q]
        c0, c1, c2, over = (np.zeros(len(q), dtype=np.uint64) for _ in range(4))
        for at in range(0, len(order), LOOK):
            for p in order[at : at + LOOK]:
                x = planes[p][word] ^ (np.uint64(0) - ((value >> np.uint64(p)) & ONE))
                carry = c0 & x
                c0 ^= x
                x = c1 & carry
                c1 ^= carry
                over |= c2 & x
                c2 ^= x
            alive = valid[word] & ~(over | (c2 & (c0 | c1)))  # RADIUS is 4: 5, 6, 7 or an overflow is too far
            left = np.flatnonzero(alive)
            if len(left) < 0.8 * len(q):
                q, word, value, c0, c1, c2, over, alive = (v[left] for v in (q, word, value, c0, c1, c2, over, alive))
            if not len(q):
                break
        if len(q):
            hit, lane = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _union(label, q[hit], node[word[hit], lane])
        start = stop
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame) -> DataFrame:
    """Pairs a, b of fingerprints within the radius, enough of them to connect all that link. ``fps``: distinct, one column.

    There are no null fingerprints; an empty table gives an empty one.
    """
    (name,) = fps.columns
    masks = _tables(fps.count())
    keyed = fps.select(
        F.col(name).alias("fp"),
        F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"),
    )
    tiles = keyed.groupBy("t", "key").count().filter("count > 1").select("t", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = (
        keyed.join(tiles, ["t", "key"])
        .select("t", "key", "fp", tile.alias("tile"), other.alias("other"))
        .select("t", "key", "fp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") <= F.col("other")).alias("q"), (F.col("tile") >= F.col("other")).alias("l"))
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            t = rows["t"]
            for table in np.unique(t).tolist():
                part = {k: v[t == table] for k, v in rows.items()}
                group = np.cumsum(_changes(part)) - 1
                a, b = forest(part["fp"].view(np.uint64), group, part["q"], part["l"], masks[table])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("t", "key", "fp", "i", "j", "q", "l")}
            if held is not None:
                rows = {k: np.concatenate([held[k], rows[k]]) for k in rows}
            edges = np.flatnonzero(_changes(rows))
            last = int(edges[-1]) if len(edges) else 0  # the last group may go on in the next batch
            held = {k: v[last:] for k, v in rows.items()}
            if last:
                yield from pairs({k: v[:last] for k, v in rows.items()})
        if held is not None and len(held["t"]):
            yield from pairs(held)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _changes(rows: dict[str, np.ndarray]) -> np.ndarray:
    """True where a row's group isn't that of the row before."""
    out = np.ones(len(rows["t"]), dtype=bool)
    out[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in ("t", "key", "i", "j")])
    return out


def _labelled(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, text_hash, fp and component_id for every row. Fingerprints are computed once and kept."""
    rows = cut(picked(docs, doc_id=F.col(key), text_hash=F.xxhash64(F.col(text)), fp=fingerprint_udf(F.col(text))))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp")))
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    label = cut(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(label, "fp").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed) and component_id, the least id reachable over links, for every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other. Rows that share an id are rows of their own. A null
    id is never the least; a component of null ids only has a null component_id. An empty table gives an empty one.
    """
    return _labelled(docs, text, key).select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that lead their component: those of its least id.

    Of rows that share that id and the fingerprint, one stays. Documents without an id stay one per fingerprint. Null and
    empty texts are copies of one another; an empty table gives an empty one.
    """
    leads = _labelled(docs, text, key).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = leads.groupBy("doc_id", "fp", "text_hash").agg(F.count("*").alias("n"))
    chosen = cut(counted.groupBy("doc_id", "fp").agg(F.min(F.struct("text_hash", "n")).alias("least")))
    names, text_hash, count = docs.columns, fresh(docs, "_hash"), fresh(docs, "_count")
    chosen = chosen.select(F.col("doc_id").alias(fresh(docs, "_id")), F.col("least.text_hash").alias(fresh(docs, "_same")), F.col("least.n").alias(count))
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col(text)))
    kept = hashed.join(chosen, F.col(key).eqNullSafe(F.col(chosen.columns[0])) & (F.col(text_hash) == F.col(chosen.columns[1])))
    if chosen.filter(F.col(count) > 1).isEmpty():
        return kept.select(*names)
    single = kept.filter(F.col(count) == 1).select(*names)
    return single.unionByName(kept.filter(F.col(count) > 1).dropDuplicates([key, text_hash]).select(*names))
