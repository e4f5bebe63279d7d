"""Centroid clustering by Exponion search, exact in integers.

A component x becomes floor(1024 * x), and centroids, sums and squared distances are whole numbers, so ties are ties and
the result doesn't depend on the order of rows. Each vector carries an upper bound of the distance to its centroid and a
lower bound of the distance to any other. A round that can't change the vector by these bounds costs it no distance.
Otherwise the bound is tightened, and if need be the centroids in a ball around the own one are tried: those up to
2 * upper + the distance to its nearest neighbour away, which hold the nearest and the second nearest. Each centroid's
list of the others, sorted by distance, gives the ball; its radius is inclusive, so that ties aren't lost.

A round is one pass over a table in the shared folder, that of the round before, and writes the next one; a lost executor
costs its tasks of one round. Only what moved between clusters is summed, in the tasks first, then by cluster and
component; the driver gets ``clusters`` * (components + 1) sums a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import new_folder, picked, remove_folder

SCALE = 1024
#: Components of which none reaches this keep squared distances below 2 ** 63, up to 64 of them. Vectors and centroids
#: beyond it are compared by Python's integers.
NARROW = 1 << 27
#: Share by which rounding may falsify a bound.
EPS = 1e-9
#: Sums of wide vectors travel in digits of so many bits.
DIGIT = 40
MOST = (1 << 63) - 1
STATE = "vec_id {}, q array<int>, wide array<double>, cluster int, upper double, lower double, distance bigint, digit int, sums array<bigint>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def kept(vectors: DataFrame, dimension: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, q and wide: the vectors that have all their components, none null or non-finite.

    q holds the whole numbers if all are below ``NARROW``; else wide holds the components as they are.
    """
    rows = picked(vectors, vec_id=F.col(key), x=F.col(vector).cast("array<double>"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.filter((F.size("x") == dimension) & F.forall("x", finite))
    narrow = F.forall("x", lambda v: F.abs(v) < NARROW / SCALE)
    return rows.select("vec_id", F.when(narrow, F.transform("x", lambda v: F.floor(v * SCALE).cast("int"))).alias("q"), F.when(~narrow, F.col("x")).alias("wide"))


def whole(components: list[float]) -> list[int]:
    """floor(1024 * x) of each, however large."""
    return [math.floor(SCALE * x) if abs(x) < 1 << 60 else int(x) * SCALE for x in components]


def first_centroids(rows: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors with the least hashes of their ids, ascending. Null ids come last; of rows with one id the least vector does first."""
    place = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(place.asc_nulls_last(), "q", "wide").limit(clusters).collect()
    return [list(r["q"]) if r["q"] is not None else whole(r["wide"]) for r in found]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact in 64 bits."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids of a round in a worker; ``moved``: how far each has come since the round before."""

    def __init__(self, at: list[list[int]], moved: list[float]):
        self.exact, self.moved = at, np.array(moved)
        self.narrow = all(abs(x) < NARROW for c in at for x in c)
        if not self.narrow:
            return
        self.at = np.array(at, dtype=np.int64)
        k = len(at)
        apart = np.sqrt([squares(self.at, c) for c in self.at])
        self.order = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), apart))
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1)
        top = np.argsort(-self.moved)[:2]  # how far any but the own centroid may have come
        self.others = np.where(np.arange(k) == top[0], self.moved[top[-1]] if k > 1 else 0.0, self.moved[top[0]])

    def assign(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters and bounds after this round, from those before it."""
        cluster, upper, lower = cluster.copy(), upper + self.moved[cluster], lower - self.others[cluster]
        sure = lambda at: upper[at] * (1 + EPS) < np.maximum(lower[at], self.nearest[cluster[at]] / 2) * (1 - EPS)
        rest = np.arange(len(q))
        rest = rest[~sure(rest)]
        upper[rest] = np.sqrt(squares(q[rest], self.at[cluster[rest]]))
        rest = rest[~sure(rest)]
        if not len(rest):
            return cluster, upper, lower
        own, radius = cluster[rest], (2 * upper[rest] + self.nearest[cluster[rest]]) * (1 + EPS)
        inside = np.zeros(len(rest), dtype=np.int64)  # centroids in the ball
        for c in np.unique(own):
            of = own == c
            inside[of] = np.searchsorted(self.sorted[c], radius[of], side="right")
        best = np.full(len(rest), MOST)
        second, choice = best.copy(), np.full(len(rest), len(self.at))
        for rank in range(int(inside.max())):
            live = np.flatnonzero(inside > rank)
            c = self.order[own[live], rank]
            d = squares(q[rest[live]], self.at[c])
            better = (d < best[live]) | ((d == best[live]) & (c < choice[live]))
            second[live] = np.where(better, best[live], np.minimum(second[live], d))
            best[live], choice[live] = np.where(better, d, best[live]), np.where(better, c, choice[live])
        cluster[rest], upper[rest], lower[rest] = choice, np.sqrt(best), np.sqrt(second)
        return cluster, upper, lower

    def scan(self, vector: list[int]) -> tuple[int, int]:
        """(squared distance, cluster) of the nearest centroid by Python's integers."""
        return min((sum((x - y) ** 2 for x, y in zip(vector, c, strict=True)), i) for i, c in enumerate(self.exact))


def _digits(n: int) -> list[int]:
    """``n`` in digits of ``DIGIT`` bits, the last of which has its sign."""
    out = []
    while not -(1 << 62) <= n < 1 << 62:
        out.append(n & ((1 << DIGIT) - 1))
        n >>= DIGIT
    return [*out, n]


def _step(at: list[list[int]], moved: list[float], dimension: int, final: bool):
    """One round over rows of ``STATE``: the same rows with clusters and bounds, then a row of sums for each cluster that changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(at, moved)
        change: dict[int, list[int]] = {}

        def count(clusters: np.ndarray, values: np.ndarray, sign: int) -> None:
            for c in np.unique(clusters[clusters >= 0]).tolist():
                total = [*values[clusters == c].sum(axis=0).tolist(), int((clusters == c).sum())]
                change[c] = [a + sign * b for a, b in zip(change.get(c, [0] * (dimension + 1)), total, strict=True)]

        for batch in batches:
            n, q = batch.num_rows, batch.column(1)
            if not n:
                continue
            before = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = before < 0
            upper = np.where(fresh, np.inf, batch.column(4).to_numpy(zero_copy_only=False))
            lower = np.where(fresh, 0.0, batch.column(5).to_numpy(zero_copy_only=False))
            after, distance = np.maximum(before, 0), np.full(n, -1, dtype=np.int64)
            narrow = np.flatnonzero(q.is_valid().to_numpy(zero_copy_only=False) & centroids.narrow)
            if len(narrow):
                values = q.filter(q.is_valid()).flatten().to_numpy().reshape(-1, dimension).astype(np.int64)
                after[narrow], upper[narrow], lower[narrow] = centroids.assign(values, after[narrow], upper[narrow], lower[narrow])
                if not final:
                    went = before[narrow] != after[narrow]
                    count(before[narrow][went], values[went], -1)
                    count(after[narrow][went], values[went], 1)
                else:
                    distance[narrow] = squares(values, centroids.at[after[narrow]])
            other = np.ones(n, dtype=bool)
            other[narrow] = False
            for i in np.flatnonzero(other).tolist():
                vector = q[i].as_py() or whole(batch.column(2)[i].as_py())
                d, after[i] = centroids.scan(vector)
                upper[i], lower[i] = np.inf, 0.0
                distance[i] = d if d <= MOST else -1
                if before[i] != after[i]:
                    for c, sign in ((before[i], -1), (after[i], 1)):
                        count(np.array([c]), np.array([vector], dtype=object), sign)
            none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))
            bounds = [pa.array(after.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance, mask=distance < 0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *bounds, *none], NAMES)
        rows = []
        for c, totals in sorted(change.items()):
            split = [_digits(t) for t in totals]
            rows += [{"cluster": c, "digit": d, "sums": [s[d] if d < len(s) else 0 for s in split]} for d in range(max(map(len, split)))]
        if rows and not final:
            kinds = pa.schema([("cluster", pa.int32()), ("digit", pa.int32()), ("sums", pa.list_(pa.int64()))])
            found = pa.RecordBatch.from_pylist(rows, kinds)
            sample = {"vec_id": batch.schema.field(0).type, "q": q.type, "wide": batch.schema.field(2).type, "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64()}
            yield pa.RecordBatch.from_arrays([found.column(name) if name in kinds.names else pa.nulls(len(rows), sample[name]) for name in NAMES], NAMES)

    return run


def _changes(state: DataFrame) -> list[tuple[int, int, int]]:
    """(cluster, component, change of its sum) of a round; the component after the last is the count."""
    rows = state.filter(F.col("digit").isNotNull()).select("cluster", "digit", F.posexplode("sums").alias("pos", "n"))
    found = rows.groupBy("cluster", "digit", "pos").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()
    return [(r["cluster"], r["pos"], int(r["n"]) << (DIGIT * r["digit"])) for r in found]


def clustered(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dimension: int = 64, salt: str = "3:", vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of each vector that ``kept`` keeps, and the centroids.

    Centroids start as the vectors with the least hashes, and each of the rounds assigns every vector to the nearest one
    (ties: the smaller number), then moves those with vectors to floor(sum / count). Rounds that would change nothing
    are left out. Repeated rows and null ids count like others; of fewer vectors than ``clusters`` each is a centroid. A
    table without vectors gives an empty one and no centroids. A distance that 64 bits can't hold is null.
    """
    spark, rows = vectors.sparkSession, kept(vectors, dimension, vector, key)
    schema = STATE.format(rows.schema["vec_id"].dataType.simpleString())
    at = first_centroids(rows, clusters, salt)
    if not at:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    moved, totals = [0.0] * len(at), [[0] * (dimension + 1) for _ in at]
    rows = rows.select("*", F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("upper"), F.lit(None).cast("double").alias("lower"))
    folder = None
    for number in range(rounds + 1):
        final, before = number == rounds, folder
        folder = new_folder(spark, "clusters")
        rows.mapInArrow(_step(at, moved, dimension, final), schema).write.parquet(folder)
        state = spark.read.schema(schema).parquet(folder)
        if before:
            remove_folder(spark, before)
        if final:
            break
        for c, pos, n in _changes(state):
            totals[c][pos] += n
        then, at = at, [[s // t[-1] for s in t[:-1]] if t[-1] else c for c, t in zip(at, totals, strict=True)]
        moved = [_distance(a, b) for a, b in zip(then, at, strict=True)]
        rows = state.filter(F.col("digit").isNull()).select(*NAMES[:6])
        if then == at and number < rounds - 1:  # all further rounds are alike: only the distances are wanted
            before, folder = folder, new_folder(spark, "clusters")
            rows.mapInArrow(_step(at, moved, dimension, True), schema).write.parquet(folder)
            remove_folder(spark, before)
            state = spark.read.schema(schema).parquet(folder)
            break
    return state.select("vec_id", "cluster", "distance"), at


def _distance(a: list[int], b: list[int]) -> float:
    """An upper bound of the distance; infinite if no double holds it."""
    d = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    return math.sqrt(d) * (1 + EPS) if d < 1 << 1000 else math.inf


def centroid_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dimension: int = 64, salt: str = "3:", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia (sums of distances) and centroid_sha256, as ``clustered`` says.

    A sum with a null distance in it, or one that 64 bits can't hold, is null. Other columns of ``vectors`` are left out.
    """
    found, at = clustered(vectors, clusters, rounds, dimension, salt, vector, key)
    if not at:
        none = {"cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return found.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in none.items()))
    got = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    sums = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in got}
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda n: n if n is not None and n <= MOST else None

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    texts = [",".join(map(str, c)) for c in at]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([fits(sums.get(c)) for c in range(len(at))], "long").alias("cluster_inertia"),
        F.lit(fits(total)).cast("long").alias("inertia"),
        F.sha2(of_cluster(texts, "string"), 256).alias("centroid_sha256"),
    )


def sql(clusters: int = 8, rounds: int = 10, dimension: int = 64, salt: str = "3:") -> str:
    """The same rows as SQL over ``embeddings``, a step after the other."""
    near = """SELECT row_id, min(packed) % {k} AS c, min(packed) // {k} AS d FROM (
        SELECT p.row_id AS row_id, sum((p.q - m.q) * (p.q - m.q)) * {k} + m.c AS packed FROM parts p JOIN m{i} m ON p.pos = m.pos GROUP BY p.row_id, m.c) GROUP BY row_id"""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, embedding) - 1 AS row_id FROM embeddings
        WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})""",
        f"""parts AS MATERIALIZED (SELECT row_id, pos, floor({SCALE} * embedding[pos]::DOUBLE)::BIGINT AS q FROM v, range(1, {dimension + 1}) AS r(pos))""",
        f"m0 AS MATERIALIZED (SELECT row_id AS c, pos, q FROM parts WHERE row_id < {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(k=clusters, i=i)})")
        if i < rounds:
            mean = "(sum(q) - (((sum(q) % count(*)) + count(*)) % count(*))) // count(*)"
            steps.append(f"n{i} AS (SELECT a.c, p.pos, ({mean})::BIGINT AS q FROM a{i} a JOIN parts p ON a.row_id = p.row_id GROUP BY a.c, p.pos)")
            steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, m.pos, coalesce(n.q, m.q) AS q FROM m{i} m LEFT JOIN n{i} n ON m.c = n.c AND m.pos = n.pos)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)} SELECT v.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
        sum(a.d) OVER ()::BIGINT AS inertia, h.sha AS centroid_sha256 FROM {last} a JOIN v ON v.row_id = a.row_id
        JOIN (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY pos)) AS sha FROM m{rounds} GROUP BY c) h ON h.c = a.c"""
