"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are quantised to integers. With one more coordinate, sqrt(M - |x|^2) for
candidates and 0 for queries (M: the largest |x|^2), order by Euclidean distance
is order by inner product: d^2 = |q|^2 + M - 2 q.x. Then

1. every vector goes to the cell of its nearest pivot;
2. summaries of cells hold the radius of the queries in them and the smallest
   candidate distances to the pivot;
3. from these alone follows a bound on the k-th neighbour's distance of every
   query of a cell; cells of queries are gathered into groups of bounded size;
4. a candidate is replicated to a group only if, by the triangle inequality or
   the hyperplane between pivots, it can be within the bound of one of its cells;
5. each group is solved against blocks of its candidates, and the best of the
   blocks are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ship

#: Widens every bound against rounding of square roots.
_SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: float = 256.0
    #: Pivots: the square root of the number of vectors, between these.
    pivots: int = 32
    most_pivots: int = 1024
    #: Queries of a group, and candidates of a block, at most (of hashed blocks: on average).
    group_queries: int = 512
    block_rows: int = 4096


def quantise(rows: DataFrame, settings: Settings) -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds floor(scale * x) as longs."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    v = F.transform(e, lambda x: F.floor(F.lit(settings.scale) * x.cast("double")).cast("long"))
    return rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad).select("vec_id", v.alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the long range they are clipped to it."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _groups(cells: list[tuple[int, int]], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """(group, parts) of each query cell: near cells together, at most ``most`` queries; larger cells are cut in parts."""
    left = dict(cells)
    out: dict[int, tuple[int, int]] = {}
    group = 0
    while left:
        seed = max(left, key=lambda c: (left[c], -c))
        near = sorted(left, key=lambda c: (float(((pivots[c] - pivots[seed]) ** 2).sum()), c))
        parts, held = max(1, math.ceil(left[seed] / most)), 0
        for c in near:
            if c == seed or held + left[c] <= most:
                out[c] = group, parts if c == seed else 1
                held += left.pop(c)
                if parts > 1:
                    break
        group += 1
    return out


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "qv").orderBy(F.col("score").desc(), "vec_id", "copy")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query row.

    ``is_query`` is a condition on vec_id. Candidates are all rows whose vec_id
    isn't the query's, repeated rows included; a query row that repeats with the
    same vector is answered once. Ties go to the smaller vec_id. Rows with a null
    vec_id, a null vector, or null or non-finite components take no part; only
    vectors of equal length meet. Components and scores beyond the range of a
    long are clipped to it, and tie there. An empty table gives an empty result;
    other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialise(quantise(vectors, settings), "vectors")
    lengths = [r[0] for r in rows.select(F.size("v").alias("n")).distinct().collect()]
    parts = [_solve(rows.filter(F.size("v") == n), is_query, settings) for n in sorted(lengths) if n > 0]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _solve(rows: DataFrame, is_query, s: Settings) -> DataFrame:
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top, n = rows.agg(F.max(squares), F.count("*")).first()
    # pivots: a bounded sample, the distinct vectors with the smallest hashes
    hashed = rows.select(F.xxhash64("v").alias("h"), "v")
    chosen = hashed.select("h").distinct().orderBy("h").limit(min(s.most_pivots, max(s.pivots, math.isqrt(n))))
    sample = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()
    pivots = np.array([r.v for r in sample], np.float64)
    norms = (pivots**2).sum(1)
    points = np.concatenate([pivots, np.sqrt(np.maximum(0, top - norms))[:, None]], 1)
    gaps = np.sqrt(np.maximum(0, ((points[:, None] - points[None]) ** 2).sum(2)))

    def distances(v: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = np.concatenate([v.astype(np.float64), last[:, None]], 1)
        d = (x**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * x @ points.T
        return np.sqrt(np.maximum(0, d))

    def as_candidate(v: np.ndarray) -> np.ndarray:
        return distances(v, np.sqrt(np.maximum(0, top - (v.astype(np.float64) ** 2).sum(1))))

    def assign(query: bool):
        def run(batches):
            for batch in batches:
                v = _matrix(batch.column("v"))
                if len(v):
                    d = distances(v, np.zeros(len(v))) if query else as_candidate(v)
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(v)), cell])], ["vec_id", "v", "cell", "d"])

        return run

    kind = "vec_id long, v array<long>, cell int, d double"
    queries = materialise(rows.filter(is_query).distinct().mapInArrow(assign(True), kind), "queries")
    candidates = materialise(rows.mapInArrow(assign(False), kind), "candidates")
    # summaries: a few numbers for each pivot
    radius = {r.cell: (r.d, r.n) for r in queries.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()}
    copies = candidates.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    need = s.k + copies  # rows with the query's own id don't count
    nearest = Window.partitionBy("cell").orderBy("d")
    inner: dict[int, list[tuple[float, int]]] = {}
    # copies is 1 unless ids repeat; beyond a bound the k-th distance is replaced by the cell's radius
    if need <= 1000:
        for r in candidates.select("cell", "d").withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= need).collect():
            inner.setdefault(r.cell, []).append((r.d, 1))
    else:
        for r in candidates.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():
            inner[r.cell] = [(r.d, r.n)]
    bound = {}
    for i, (r, _) in radius.items():
        # an augmented query lies at its own distance from pivot i, so this holds for all queries of the cell
        bound[i], seen = math.inf, 0
        for far, m in sorted((r + gaps[i, j] + d, m) for j, ds in inner.items() for d, m in ds):
            seen += m
            if seen >= need:
                bound[i] = far * _SLACK + 1e-6
                break
    grouped = _groups([(i, c) for i, (_, c) in radius.items()], points, s.group_queries)
    count = 1 + max((g for g, _ in grouped.values()), default=-1)
    cells = sorted(grouped)
    parts_of = [1] * count
    for g, p in grouped.values():
        parts_of[g] = max(parts_of[g], p)

    def groups_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of all groups that candidates can be needed in."""
        d = as_candidate(v)
        own = d.argmin(1)
        nearest = d[np.arange(len(v)), own]
        needed = np.zeros((len(v), count), bool)
        for i in cells:
            low = d[:, i] - radius[i][0]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d[:, i] ** 2 - nearest**2) / (2 * gaps[i, own])
            # a query of cell i is nearer to pivot i than to the candidate's: the plane between them parts the two
            low = np.maximum(low, np.where(gaps[i, own] > 0, plane, 0))
            needed[:, grouped[i][0]] |= low <= bound[i]
        return np.nonzero(needed)

    def tally(batches):
        total = np.zeros(count, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"))
            if len(v) and cells:
                total += np.bincount(groups_of(v)[1], minlength=count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count), pa.int32()), pa.array(total)], ["g", "n"])

    # a row for each group, and there are no more groups than pivots
    sizes = {r.g: r.n for r in candidates.select("v").mapInArrow(tally, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    blocks = np.maximum(1, -(-np.array([sizes.get(g, 0) for g in range(count)], np.int64) // s.block_rows))

    def replicate(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            if not len(v) or not cells:
                continue
            at, g = groups_of(v)
            mark = np.array([hash(x) & 0x7FFFFFFF for x in zip(batch.column("vec_id").to_pylist(), v[:, 0].tolist(), strict=True)], np.int64)
            block = (mark[at] % blocks[g]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(block), batch.column("vec_id").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["g", "block", "vec_id", "v"])

    part = {i: (g, p) for i, (g, p) in grouped.items()}
    places = rows.sparkSession.createDataFrame([(i, g, p, int(blocks[g])) for i, (g, p) in part.items()] or [(-1, -1, 1, 1)], "cell int, g int, parts int, blocks int")
    asked = queries.join(F.broadcast(places), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    asked = asked.select("g", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    shape = rows.sparkSession.createDataFrame([(g, p) for g, p in enumerate(parts_of)] or [(-1, 1)], "g int, parts int")
    sent = candidates.select("vec_id", "v").mapInArrow(replicate, "g int, block int, vec_id long, v array<long>")
    sent = sent.join(F.broadcast(shape), "g").select("g", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
    k = s.k

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
            qid, xid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(xid, kind="stable")
            x, xid = x[order], xid[order]
            for a in range(0, len(q), 256):
                score = _products(q[a : a + 256], x)
                for i in range(len(score)):
                    others = np.flatnonzero(xid != qid[a + i])
                    row = score[i][others]
                    if len(row) > k:
                        kth = np.partition(row, len(row) - k)[len(row) - k]
                        above = np.flatnonzero(row > kth)
                        level = np.flatnonzero(row == kth)[: k - len(above)]  # ids ascend
                        others, row = others[np.concatenate([above, level])], row[np.concatenate([above, level])]
                    out += [(int(qid[a + i]), q[a + i].tolist(), int(xid[o]), int(sc), c) for c, (o, sc) in enumerate(zip(others.tolist(), row.tolist(), strict=True))]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "qv", "vec_id", "score", "copy"])

    key = ["g", "part", "block"]
    local = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, "query_id long, qv array<long>, vec_id long, score long, copy int")
    best = _top(local, s.k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
