"""Near copies by what texts hold: five-word shingles with a Jaccard similarity of 0.8 or more, verified exactly.

Texts with the same set of shingles are one node. Candidates are nodes whose SimHash fingerprints link (``near_dedup``: 4 or
fewer differing bits, compared bit-sliced), and, since pairs at a similarity of 0.8 lie further apart than that, nodes
that share a band of MinHash values: 24 bands of four values find a pair at a similarity of 0.8 but for a chance of 1 - (1 - 0.8 ** 4) ** 24, 3 in a million, and a
closer one more surely. Buckets with the same members count once. In each bucket the sets themselves are compared,
a node only with those that nothing has reached yet, so a group of mutual copies takes one comparison a node. A large
bucket is cut into tiles; pairs of tiles are compared, and only the links of a spanning forest are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import near_dedup
from corpusmill.llm.common import cut, fresh, picked, portions
from corpusmill.llm.components import components

SHINGLE = 5
#: Least similarity, as a fraction: 4 / 5.
SHARE, OF = 4, 5
BANDS, WIDTH = 24, 4
#: Nodes in a tile of a bucket.
TILE = 512
#: Shingles whose values are computed at a time.
STEP = 4096
MIX, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_draw = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (2, BANDS * WIDTH, 1), dtype=np.uint64)
FACTOR, SHIFT = _draw[0] | np.uint64(1), _draw[1]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * END
    x = (x ^ (x >> np.uint64(32))) * END
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the different shingles, ascending; a shorter text is one shingle, and one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    n = len(hashes) - SHINGLE + 1
    out = hashes[:n]
    for i in range(1, SHINGLE):
        out = _stirred(out * MIX + hashes[i : i + n])
    return np.unique(out)


def band_keys(held: np.ndarray) -> np.ndarray:
    """A hash of the least values of each band; no keys if there are no shingles."""
    if not len(held):
        return np.zeros(0, dtype=np.int64)
    least = np.min([(FACTOR * held[at : at + STEP] + SHIFT).min(axis=1) for at in range(0, len(held), STEP)], axis=0).reshape(BANDS, WIDTH)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(WIDTH):
        key = _stirred(key * MIX + least[:, i])
    return key.view(np.int64)


def alike(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between sets that are similar enough, as many as connect all that such links connect."""
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(words), dtype=bool)
    left = np.ones(len(sets), dtype=bool)
    rest, of = flat, owner
    a, b = [], []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            one = queue.pop()
            own = flat[ends[one] - sizes[one] : ends[one]]
            mark[own] = True
            both = np.bincount(of[mark[rest]], minlength=len(sets))
            mark[own] = False
            near = np.flatnonzero(left & (OF * both >= SHARE * (sizes + sizes[one] - both))).tolist()
            left[near] = False
            queue += near
            a += [one] * len(near)
            b += near
            if len(near) > 8 or not queue:
                stay = left[of]
                rest, of = rest[stay], of[stay]
    return a, b


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set of shingles), fp (the SimHash fingerprint) and keys for each row."""
    rows = picked(docs, doc_id=F.col(key), text_hash=F.xxhash64(F.col(text)), text=F.col(text))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            nodes, fps, keys = [], [], []
            for t in batch.column(2).to_pylist():
                held = shingles(t)
                nodes.append(xxhash.xxh64_intdigest(held.tobytes()))
                fps.append(near_dedup.fingerprint(t))
                keys.append(band_keys(held))
            hashes = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *hashes, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "fp", "keys"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, text_hash bigint, node bigint, fp bigint, keys array<bigint>")


def simhash_keys(rows: DataFrame) -> DataFrame:
    """node and same: hashes of the groups of linked SimHash fingerprints that a node's texts are in. Nodes without shingles have none."""
    fps = cut(rows.filter(F.size("keys") > 0).select("node", "fp").distinct())
    roots = components(near_dedup.links(fps.select("fp").distinct()))
    group = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy("node").agg(F.collect_set(group).alias("same"))


def _held(rows: DataFrame) -> DataFrame:
    """node and held, the bytes of its shingles, for rows of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "held"])

    return rows.mapInArrow(run, "node bigint, held binary").groupBy("node").agg(F.first("held").alias("held"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of each group of rows with one key and pair of tiles, which come one after the other."""
    group, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        a, b = alike(sets)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in a], pa.int64()), pa.array([nodes[x] for x in b], pa.int64())], ["a", "b"])

    for batch in portions(batches):
        for key, i, j, node, held in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "held")), strict=True):
            if (key, i, j) != group:
                if len(nodes) > 1:
                    yield links()
                group, nodes, sets = (key, i, j), [], []
            nodes.append(node)
            sets.append(np.frombuffer(held, dtype=np.uint64))
    if len(nodes) > 1:
        yield links()


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pairs a, b of nodes that connect all that is similar. ``nodes``: node, lead (doc_id and text_hash of one of its rows) and keys."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    same = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("n > 1")
    tiles = same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    members = cut(keyed.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("lead.doc_id").alias("_id"), F.col("lead.text_hash").alias("_hash"))
    texts = picked(docs, doc_id=F.col(key), text=F.col(text))
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("node", "text")
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: o != F.col("tile")))  # a pair of tiles also compares each with itself
    placed = members.withColumn("other", F.explode(others)).select("node", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.join(_held(held), "node").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked, "a bigint, b bigint")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: of each component the row with the least id.

    Null and empty texts are copies of one another. A null id is the least only where there is no other. Of rows that
    share id and text, one stays.
    """
    rows = cut(sketched(docs, text, key))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = rows.groupBy("node").agg(F.min(lead).alias("lead"), F.first("keys").alias("keys")).join(simhash_keys(rows), "node", "left")
    nodes = cut(nodes.select("node", "lead", F.concat("keys", F.coalesce("same", F.array().cast("array<bigint>"))).alias("keys")))
    roots = components(cut(links(docs, nodes, text, key)))
    leads = nodes.select("node", "lead").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("lead").alias("lead")).select("lead.doc_id", "lead.text_hash")
    counted = rows.groupBy("doc_id", "text_hash").count()
    same = F.col("l.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("l.text_hash") == F.col("c.text_hash"))
    names, text_hash, count = docs.columns, fresh(docs, "_hash"), fresh(docs, "_count")
    chosen = cut(leads.alias("l").join(counted.alias("c"), same).select(F.col("l.doc_id").alias(fresh(docs, "_id")), F.col("l.text_hash").alias(fresh(docs, "_same")), F.col("count").alias(count)))
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col(text)))
    kept = hashed.join(chosen, F.col(key).eqNullSafe(F.col(chosen.columns[0])) & (F.col(text_hash) == F.col(chosen.columns[1])))
    if chosen.filter(F.col(count) > 1).isEmpty():
        return kept.select(*names)
    single = kept.filter(F.col(count) == 1).select(*names)
    return single.unionByName(kept.filter(F.col(count) > 1).dropDuplicates([key, text_hash]).select(*names))
