"""Exact k-nearest-neighbour join with bounded output, and the SMOTE /
Tomek-link operators built on it (I3, I4).

kNN:
  * the first rows in a seeded order (at most ``SAMPLE``) are a sample; its first
    ``n_pivots`` vectors are pivots. The k-th distance of a query to the sample
    bounds the distance of its k-th neighbour from above;
  * points and queries are dealt by hash into groups of at most ``GROUP_BYTES``
    of vectors, and each pair of a query group and a point group is one group of
    a cogrouped job: memory is bounded, and both tables are copied as often as
    the other one has groups;
  * inside a pair the points are sorted by (nearest pivot, distance to it) and cut
    into blocks. A block is passed over where the triangle inequality keeps it
    farther than the query's bound; the rest is compared by matrix products of
    single precision, of vectors less a centre. Queries that may have a point of
    the block within their bound plus the rounding error are compared again in
    double precision. These products have a rounding error, too, so all points
    within the bound plus that error are measured by the sum of squared
    differences, in component order;
  * a pair returns at most k rows a query, ranked over all point groups by
    (distance, id). No candidate cap: ties and near ties are all measured.
Rows without an id, and vectors that are null or hold null or non-finite
components, take no part; vectors of different length are no neighbours.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featflow.operators.ranking import hash_rank, seeded_hash
from featflow.session import ensure_checkpoint_dir

SAMPLE, BLOCK = 1024, 1024
GROUP_BYTES = 32 << 20
MAX_TASKS = 10_000


def _as_double_array(c: str) -> Column:
    return F.col(c).cast("array<double>")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A list<double> column of one length as an array of rows."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _roots(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1) - 2 * (q @ p.T), 0))


def _measured(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed up in component order."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        gap = q[:, i] - p[:, i]
        total += gap * gap
    return total


class _Coarse:
    """Squared distances in single precision, less the queries' squared lengths.
    The error is bounded relative to the sum of both squared lengths, by twice
    what rounding of input, products and sums can come to."""

    def __init__(self, q: np.ndarray, p: np.ndarray, centre: np.ndarray):
        q, p = q - centre, p - centre
        self.usable = 1e-12 < max(np.abs(q).max(), np.abs(p).max()) < 1e15           # squares neither run over nor vanish beside the largest
        if self.usable:
            self.size_q, self.size_p = (q * q).sum(1), (p * p).sum(1)
            self.q, self.p = np.c_[q, np.ones(len(q))].astype(np.float32), np.c_[-2 * p, self.size_p].astype(np.float32)
            self.share = (q.shape[1] + 16) * 2.5e-7

    def within(self, rows: np.ndarray, a: int, b: int, limit: np.ndarray) -> np.ndarray:
        """Places of the query ``rows`` that may have one of the points a to b within their ``limit``."""
        if not self.usable:
            return np.arange(len(rows))
        error = self.share * (self.size_q[rows] + self.size_p[a:b].max()) + 1e-37
        return np.flatnonzero((self.q[rows] @ self.p[a:b].T).min(1) <= limit - self.size_q[rows] + error)


def _search(q: np.ndarray, q_id: np.ndarray, p: np.ndarray, p_id: np.ndarray, k: int, pivots: np.ndarray,
            bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, squared distance) of the k nearest points of each
    query that lie within ``bound`` (squared) or are among these; ids decide ties."""
    slack = (q.shape[1] + 16) * 1e-15
    reach = (pivots * pivots).sum(1).max()
    to_pivot = _roots(p, pivots)
    cell = to_pivot.argmin(1)
    own = to_pivot[np.arange(len(p)), cell]
    order = np.lexsort((own, cell))
    p, p_id, cell, own, back = p[order], p_id[order], cell[order], own[order], order
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cuts = [(a, min(a + BLOCK, b)) for x, b in zip(starts, [*starts[1:], len(p)]) for a in range(x, b, BLOCK)]
    norm_p = (p * p).sum(1)
    q_pivot = _roots(q, pivots)
    coarse = _Coarse(q, p, pivots.mean(0))
    out = []
    by_cell = np.argsort(q_pivot.argmin(1), kind="stable")
    for at in range(0, len(q), BLOCK):
        rows = by_cell[at:at + BLOCK]
        mine, ids, far = q[rows], q_id[rows], q_pivot[rows]
        norm = (mine * mine).sum(1)
        limit = bound[rows].copy()
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)           # row of the chunk, point, distance
        gaps = np.stack([np.maximum(far[:, cell[a]] - own[b - 1], own[a] - far[:, cell[a]]) for a, b in cuts], 1)
        for j in np.argsort(gaps.mean(0), kind="stable"):
            a, b = cuts[j]
            error = slack * (norm + norm_p[a:b].max())
            # roots of rounded squares: their error is at most the root of the squares' error
            live = np.flatnonzero((gaps[:, j] - 4 * np.sqrt(error + slack * reach)) <= np.sqrt(limit))
            live = live[coarse.within(rows[live], a, b, limit[live])]
            if not len(live):
                continue
            d = norm[live, None] + norm_p[a:b] - 2 * (mine[live] @ p[a:b].T)
            d[ids[live, None] == p_id[a:b]] = np.inf
            top = limit[live]
            if b - a > k:
                top = np.minimum(top, d.min(1) if k == 1 else np.partition(d, k - 1, axis=1)[:, k - 1])
            near, point = np.nonzero(~(d > (top + 2 * error[live])[:, None]))
            row, point = live[near], point + a
            keep = ids[row] != p_id[point]
            row, point = row[keep], point[keep]
            exact = np.concatenate([_measured(mine[row[i:i + 65536]], p[point[i:i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
            row, point, exact = (np.concatenate(x) for x in zip(best, (row, point, exact)))
            by = np.lexsort((p_id[point], exact, row))
            row, point, exact = row[by], point[by], exact[by]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            best = row[nth < k], point[nth < k], exact[nth < k]
            kth = nth == k - 1
            limit[row[kth]] = np.minimum(limit[row[kth]], exact[kth])
        out.append((rows[best[0]], back[best[1]], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pair(queries: pa.Table, points: pa.Table, k: int, given: Broadcast) -> pa.Table:
    """The k nearest of a point group for each row of a query group."""
    found: list[pa.Table] = []
    q_size, p_size = (np.asarray(t.column("size")) for t in (queries, points))
    names, codes = np.unique(np.concatenate([points.column("pid").to_numpy(), queries.column("qid").to_numpy()]), return_inverse=True)
    for size in np.intersect1d(q_size, p_size):
        q_at, p_at = np.flatnonzero(q_size == size), np.flatnonzero(p_size == size)
        q, p = _vectors(queries.column("qv").take(pa.array(q_at))), _vectors(points.column("v").take(pa.array(p_at)))
        sample, sample_id, pivots = given.value.get(int(size)) or (np.zeros((0, size)), [], 0)
        bound = np.full(len(q), np.inf)
        if len(sample) > k:
            known = dict(zip(names.tolist(), range(len(names))))
            ids = np.array([known.get(x, -1) for x in sample_id])
            for i in range(0, len(q), BLOCK):
                mine = q[i:i + BLOCK]
                norm, other = (mine * mine).sum(1), (sample * sample).sum(1)
                d = norm[:, None] + other - 2 * (mine @ sample.T)
                d[codes[len(p_size) + q_at[i:i + BLOCK], None] == ids] = np.inf
                bound[i:i + BLOCK] = np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0) + 2 * (size + 16) * 1e-15 * (norm + other.max())
        row, point, d = _search(q, codes[len(p_size) + q_at], p, codes[p_at], k, sample[:pivots] if pivots else p[:1], bound)
        found.append(pa.table({"qid": queries.column("qid").take(pa.array(q_at[row])), "nn_id": points.column("pid").take(pa.array(p_at[point])),
                               "sqdist": pa.array(d)}))
    if found:
        return pa.concat_tables(found)
    return pa.table({"qid": queries.column("qid").slice(0, 0), "nn_id": points.column("pid").slice(0, 0), "sqdist": pa.array([], pa.float64())})


def knn(points: DataFrame, id_col: str, vec_col: str, k: int, queries: DataFrame | None = None,
        n_pivots: int = 64, seed: int = 42, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(qid, nn_id, nn_rank 1..k, sqdist) - exact k nearest ``points`` of every
    query (default: the points themselves, excluding the same id); ties by id."""
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)

    def usable(df: DataFrame, name: str, vec: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias(name), _as_double_array(vec_col).alias(vec))
        fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        return rows.where(F.col(name).isNotNull() & F.col(vec).isNotNull() & fine).withColumn("size", F.size(vec)).where("size > 0")

    pts = usable(points, "pid", "v").checkpoint()
    qs = usable(queries, "qid", "qv").checkpoint() if queries is not None else pts.select(F.col("pid").alias("qid"), F.col("v").alias("qv"), "size")
    id_type, q_type = pts.schema["pid"].dataType.simpleString(), qs.schema["qid"].dataType.simpleString()
    seen = pts.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    asked = seen if queries is None else qs.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    if not seen["n"] or not asked["n"] or k < 1:
        return spark.createDataFrame([], f"qid {q_type}, nn_id {id_type}, nn_rank int, sqdist double")
    given: dict[int, tuple] = {}
    for r in pts.orderBy(seeded_hash("pid", seed), "pid").limit(SAMPLE).collect():
        rows, ids, _ = given.setdefault(r["size"], ([], [], 0))
        rows.append(r["v"])
        ids.append(r["pid"])
    held = spark.sparkContext.broadcast({z: (np.array(v), ids, max(1, min(n_pivots, len(v)))) for z, (v, ids, _) in given.items()})
    p_groups = math.ceil(8 * seen["s"] / group_bytes)
    spread = min(4 * spark.sparkContext.defaultParallelism, math.ceil(asked["n"] / BLOCK))
    q_groups = max(math.ceil(8 * asked["s"] / group_bytes), math.ceil(spread / p_groups))
    parts = F.sequence(F.lit(0), F.lit(p_groups - 1)), F.sequence(F.lit(0), F.lit(q_groups - 1))
    left = qs.withColumn("qi", F.pmod(F.xxhash64("qid"), F.lit(q_groups)).cast("int")).withColumn("pj", F.explode(parts[0]))
    right = pts.withColumn("pj", F.pmod(F.xxhash64("pid"), F.lit(p_groups)).cast("int")).withColumn("qi", F.explode(parts[1]))
    # about a pair a task: its time follows from the pairs, not from the bytes that Spark would merge tasks by
    tasks = min(q_groups * p_groups, MAX_TASKS)
    left, right = left.repartition(tasks, "qi", "pj"), right.repartition(tasks, "qi", "pj")
    pairs = left.groupBy("qi", "pj").cogroup(right.groupBy("qi", "pj")).applyInArrow(
        partial(_pair, k=k, given=held), f"qid {q_type}, nn_id {id_type}, sqdist double")
    ranked = pairs.withColumn("nn_rank", F.row_number().over(Window.partitionBy("qid").orderBy("sqdist", "nn_id")).cast("int"))
    return ranked.where(F.col("nn_rank") <= k).select("qid", "nn_id", "nn_rank", "sqdist").checkpoint()


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """I3 (deterministic variant): synthetic minority rows until both classes
    have the majority's count. Synthetic row j uses minority row number
    (j mod n_min) + 1 in seeded order as its base, neighbour number
    (h1(j) mod k) + 1 among the base's k nearest minority rows, and gap
    h2(j) / 2^32 in [0, 1): new = x + gap * (x_nn - x).
    Output (syn_id, base_id, nn_id, gap, label, vector)."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    n_new = n_maj - n_min
    k = min(k, n_min - 1)        # a class of n rows has n - 1 neighbours
    if k < 1 and n_new:
        raise ValueError(f"the minority class has {n_min} row(s): no neighbour to interpolate with")
    spark = df.sparkSession
    mino = df.where(F.col(label) == minority).select(F.col(id_col).alias("id"), _as_double_array(vec_col).alias("v"))
    ranked = hash_rank(mino, "id", seed=seed, name="r")
    nn = knn(mino, "id", "v", k, seed=seed)
    h = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("j").cast("string"),
                                                         F.lit(tag))), 1, 8), 16, 10).cast("bigint")
    syn = (spark.range(n_new).withColumnRenamed("id", "j")
           .select("j", ((F.col("j") % n_min) + 1).alias("r"), ((h("nn") % k) + 1).cast("int").alias("nn_rank"),
                   (h("gap") / 4294967296.0).alias("gap")))
    base = ranked.select(F.col("r"), F.col("id").alias("base_id"), F.col("v").alias("bv"))
    syn = syn.join(base, "r").join(nn.select(F.col("qid").alias("base_id"), "nn_rank", "nn_id"), ["base_id", "nn_rank"])
    syn = syn.join(mino.select(F.col("id").alias("nn_id"), F.col("v").alias("nv")), "nn_id")
    vec = F.zip_with("bv", "nv", lambda a, b: a + F.col("gap") * (b - a))
    return syn.select(F.col("j").alias("syn_id"), "base_id", "nn_id", "gap", F.lit(minority).alias(label),
                      vec.alias("vector"))


def mutual_pairs(df: DataFrame, id_col: str, vec_col: str, label: str, seed: int = 42) -> DataFrame:
    """Pairs (a < b) that are each other's exact nearest neighbour, with
    ``is_link`` = opposite classes (a Tomek link)."""
    nn1 = knn(df, id_col, vec_col, 1, seed=seed).select("qid", "nn_id")
    lab = df.select(F.col(id_col).alias("qid"), F.col(label).alias("ql"))
    a = nn1.join(lab, "qid")
    b = a.select(F.col("qid").alias("nn_id"), F.col("nn_id").alias("qid"), F.col("ql").alias("nl"))
    m = a.join(b, ["qid", "nn_id"]).where(F.col("qid") < F.col("nn_id"))
    return m.select(F.col("qid").alias("id_a"), F.col("nn_id").alias("id_b"), F.col("ql").alias("label_a"),
                    F.col("nl").alias("label_b"), (F.col("ql") != F.col("nl")).alias("is_link"))


def remove_links(df: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Drop both members of every Tomek link (anti-join)."""
    ids = links.select(F.col("id_a").alias(id_col)).unionByName(links.select(F.col("id_b").alias(id_col)))
    return df.join(ids, id_col, "left_anti")
