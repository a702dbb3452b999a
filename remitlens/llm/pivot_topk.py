"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more component that makes all norms equal, which turns the
largest inner product into the smallest distance. Each vector is keyed by its
nearest pivot and its distance to it; a pivot's vectors, ordered by that
distance, are cut into annuli. By the triangle inequality a vector at distance
x from pivot p is at least |d(q, p) - x| away from query q. A query first looks
into the annulus that it lies in itself, whose k-th best score bounds the
distance that still matters; then it visits those annuli of all pivots that
reach within that distance, in each only the rows between its bounds.

Pivots are fitted to at most ``PIVOT_SAMPLE`` vectors, those with the least hash
of their id; every vector is indexed and the result is exact whatever the pivots.
An annulus with many vectors at one distance is dealt into slices, and the queries
that visit an annulus into blocks, so a group in memory holds about ``CELL_ROWS``
vectors and ``QUERY_ROWS`` queries. An annulus is sent once for each block of queries
that visit it, and one that none visits is not sent at all.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without a vec_id; shorter vectors count as filled up with zeros. Every row counts for
itself: rows that repeat a vec_id are candidates of each other, and each of them asks if
its vec_id does. Scores must fit 64 bits. An empty table, or one without queries, gives no
rows. Vectors of any length are whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm.common import cut, importable

PIVOTS, PIVOT_SAMPLE, PIVOT_ROUNDS = 32, 4096, 6
CELL_ROWS, MOST_ANNULI, QUERY_ROWS = 8192, 512, 16384
#: Queries whose visits are found at once; rows of a batch that is sent to cells.
VISIT_ROWS, VISITS_SENT = 1 << 10, 1 << 14
SCALE = 64
#: Integers up to here are exact in float64.
EXACT = 2**52


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``row`` (a number of its own), ``vec_id``, ``v`` (floor(scale * x) of each component x, as little-endian 64-bit integers), ``norm`` (squared), ``dim``."""
    components = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(components, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    importable(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), components.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            values = np.floor(scale * np.asarray(lists.flatten(), float)).astype("<i8")
            ends = np.cumsum(np.asarray(lists.value_lengths(), np.int64))
            parts = [values[b - n : b] for b, n in zip(ends.tolist(), lists.value_lengths().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([int(p @ p) for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int32())],
                names=["row", "vec_id", "v", "norm", "dim"],
            )

    return rows.mapInArrow(run, "row long, vec_id long, v binary, norm long, dim int")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    texts = column.to_pylist()
    whole = 8 * dim
    return np.frombuffer(b"".join(t if len(t) == whole else t.ljust(whole, b"\0") for t in texts), "<i8").reshape(len(texts), dim)


class Space:
    """The space in which all norms are equal to ``radius``; points are given as integer vectors."""

    def __init__(self, pivots: np.ndarray, top: int):
        self.pivots, self.top = pivots, top
        self.slack = 1e-9 * max(top, 1) + 1e-6

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rows = vectors.astype(float)
        return np.column_stack([rows, np.sqrt(np.maximum(self.top - (rows * rows).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To each pivot."""
        squares = (lifted**2).sum(axis=1)[:, None] - 2 * lifted @ self.pivots.T + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of queries, whose extra component is zero, to each pivot."""
        return self.distances(np.column_stack([vectors.astype(float), np.zeros(len(vectors))]))

    def reach(self, vectors: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance within which vectors of at least ``score`` lie; infinite where it is NaN."""
        norms = (vectors.astype(float) ** 2).sum(axis=1)
        far = np.sqrt(np.maximum(norms + self.top - 2 * score, 0) + self.slack) + self.slack
        return np.where(np.isnan(score), np.inf, far)


def fit_pivots(sample: np.ndarray, top: int, count: int = PIVOTS) -> Space:
    """Pivots as means of a few rounds of clustering, started from points that are far apart."""
    space = Space(np.zeros((1, sample.shape[1] + 1)), top)
    points = space.lifted(sample)
    if not len(points):
        return space
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    space.pivots = points[chosen]
    for _ in range(PIVOT_ROUNDS):
        nearest = space.distances(points).argmin(axis=1)
        space.pivots = np.array([points[nearest == k].mean(axis=0) if (nearest == k).any() else space.pivots[k] for k in range(len(space.pivots))])
    return space


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= edge)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def top_k(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query row's k highest inner products with all other rows.

    ``is_query`` is a condition on a column ``vec_id``.
    """
    vectors = cut(scaled(df, vec_id, embedding))
    total = vectors.agg(F.max("norm").alias("top"), F.max("dim").alias("dim")).first()
    top, dim = total["top"] or 0, max(total["dim"] or 0, 1)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).select("v").toArrow()
    space = fit_pivots(matrix(sample["v"], dim), top)
    index = Index(space, dim, cut(_keyed(vectors, space, dim)))
    asked = vectors.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("long").alias("bound"))
    least = index.search(asked, k, everywhere=False).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    least = least.select("query", F.when(F.col("found") >= k, F.col("least")).alias("bound"))
    bounded = cut(asked.drop("bound").join(least, "query", "left").select("query", "query_id", "v", "bound"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = index.search(bounded, k, everywhere=True).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")


def _keyed(vectors: DataFrame, space: Space, dim: int) -> DataFrame:
    """The vectors with their nearest ``pivot`` and their ``distance`` to it."""

    def run(batches):
        for batch in batches:
            far = space.distances(space.lifted(matrix(batch.column("v"), dim)))
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("v"), pa.array(pivot, pa.int64()), pa.array(far[np.arange(len(far)), pivot], pa.float64())],
                names=["row", "vec_id", "v", "pivot", "distance"],
            )

    return vectors.mapInArrow(run, "row long, vec_id long, v binary, pivot long, distance double")


class Cells:
    """The annuli of all pivots, numbered, with the distances that they span and the slices that they are dealt into."""

    def __init__(self, bounds: list[list[float]], rows: list):
        self.bounds = [np.array(b) for b in bounds]
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], float) for c in ("low", "high"))
        self.slices = np.array([-(-r["n"] // (2 * CELL_ROWS)) for r in rows], np.int64)

    def of(self, pivot: np.ndarray, distance: np.ndarray) -> np.ndarray:
        out = pivot * MOST_ANNULI
        for p in np.unique(pivot).tolist():
            here = pivot == p
            out[here] += np.searchsorted(self.bounds[p], distance[here], "right")
        return out

    def visited(self, space: Space, q: np.ndarray, bound: np.ndarray, everywhere: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries, and of cells that they visit: all that reach within their bounds, or their own annulus."""
        if not len(self.cell) or not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        from_pivot = space.of_queries(q)[:, self.cell // MOST_ANNULI]
        gap = np.maximum(np.maximum(from_pivot - self.high, self.low - from_pivot), 0)
        if everywhere:
            return np.nonzero(gap <= space.reach(q, bound)[:, None])
        return np.arange(len(q)), (gap + 1e-3 * from_pivot).argmin(axis=1)


class Index:
    """Keyed vectors cut into annuli. What comes to the driver is a row for each annulus, at most pivots times MOST_ANNULI."""

    def __init__(self, space: Space, dim: int, keyed: DataFrame):
        self.space, self.dim, self.keyed = space, dim, keyed
        count = {r["pivot"]: r["count"] for r in keyed.groupBy("pivot").count().collect()}
        annuli = {p: min(MOST_ANNULI, -(-n // CELL_ROWS)) for p, n in count.items()}
        most = max([1, *annuli.values()])
        spread = F.percentile_approx("distance", [i / most for i in range(1, most)] or [0.5], 10000)
        found = {r["pivot"]: r["b"] for r in keyed.groupBy("pivot").agg(spread.alias("b")).collect()}
        bounds = [[found[p][i * most // annuli[p] - 1] for i in range(1, annuli[p])] if p in annuli else [] for p in range(len(space.pivots))]
        self.cells = Cells(bounds, [])
        spans = self._in_cells().groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
        self.cells = Cells(bounds, spans.orderBy("cell").collect())

    def _in_cells(self) -> DataFrame:
        cells = self.cells

        def run(batches):
            for batch in batches:
                distance = np.asarray(batch.column("distance"))
                yield pa.RecordBatch.from_arrays([pa.array(cells.of(np.array(batch.column("pivot")), distance)), batch.column("distance")], names=["cell", "distance"])

        return self.keyed.select("pivot", "distance").mapInArrow(run, "cell long, distance double")

    def _dealt(self, blocks: np.ndarray) -> DataFrame:
        """Every vector once for each block of queries that visit its cell, in the slice of its row."""
        cells = self.cells

        def run(batches):
            for batch in batches:
                cell = cells.of(np.array(batch.column("pivot")), np.asarray(batch.column("distance")))
                at = np.searchsorted(cells.cell, cell)
                part = np.asarray(batch.column("row")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                times = blocks[at]
                rows = np.repeat(np.arange(len(cell)), times)
                block = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                part = (part.astype(np.int64) % cells.slices[at])[rows]
                for some in (slice(i, i + VISITS_SENT) for i in range(0, len(rows), VISITS_SENT)):
                    taken = batch.take(pa.array(rows[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (cell[rows], part, block)] + taken.columns, names=["cell", "slice", "block", *batch.schema.names])

        return self.keyed.mapInArrow(run, "cell long, slice long, block long, row long, vec_id long, v binary, pivot long, distance double")

    def visits(self, queries: DataFrame, everywhere: bool) -> np.ndarray:
        """How many queries visit each cell."""
        space, dim, cells = self.space, self.dim, self.cells

        def run(batches):
            total = np.zeros(len(cells.cell), np.int64)
            for batch in (whole.slice(i, VISIT_ROWS) for whole in batches for i in range(0, whole.num_rows, VISIT_ROWS)):
                bound = np.array(batch.column("bound").to_pylist(), float)
                total += np.bincount(cells.visited(space, matrix(batch.column("v"), dim), bound, everywhere)[1], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

        out = np.zeros(len(cells.cell), np.int64)
        for r in queries.select("v", "bound").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out

    def search(self, queries: DataFrame, k: int, everywhere: bool) -> DataFrame:
        """``query``, ``query_id``, ``vec_id``, ``score``: the k best of each visited slice for each query (``query``, ``query_id``, ``v``, ``bound``) that reach its bound."""
        space, dim, cells = self.space, self.dim, self.cells
        blocks = -(-self.visits(queries, everywhere) // QUERY_ROWS)

        def visit(batches):
            for batch in (whole.slice(i, VISIT_ROWS) for whole in batches for i in range(0, whole.num_rows, VISIT_ROWS)):
                at, cell = cells.visited(space, matrix(batch.column("v"), dim), np.array(batch.column("bound").to_pylist(), float), everywhere)
                query = np.asarray(batch.column("query"))
                times = cells.slices[cell] if everywhere else np.ones(len(cell), np.int64)
                at, cell = np.repeat(at, times), np.repeat(cell, times)
                part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                mixed = (query.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)[at]
                if not everywhere:
                    part = mixed % cells.slices[cell]
                block = mixed // 64 % blocks[cell]
                for some in (slice(i, i + VISITS_SENT) for i in range(0, len(at), VISITS_SENT)):
                    rows = batch.take(pa.array(at[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (cells.cell[cell], part, block)] + rows.columns, names=["cell", "slice", "block", *batch.schema.names])

        def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = [[], [], [], []]
            if rows.num_rows and asked.num_rows:
                rows = rows.sort_by("distance")
                own, ids, v = np.asarray(rows["row"]), np.asarray(rows["vec_id"]), matrix(rows["v"], dim)
                distance, pivot = np.asarray(rows["distance"]), int(rows["pivot"][0].as_py())
                exact = v.astype(float) if space.top <= EXACT else v
                q = matrix(asked["v"], dim)
                bound = np.array(asked["bound"].to_pylist(), float)
                reach, far = space.reach(q, bound), space.of_queries(q)[:, pivot]
                first = np.searchsorted(distance, far - reach - space.slack, "left")
                last = np.searchsorted(distance, far + reach + space.slack, "right")
                for i, (query, query_id) in enumerate(zip(asked["query"].to_pylist(), asked["query_id"].to_pylist(), strict=True)):
                    span = slice(first[i], last[i])
                    scores = exact[span] @ q[i].astype(exact.dtype)
                    fit = own[span] != query
                    if not np.isnan(bound[i]):
                        fit &= scores >= bound[i]
                    at = np.flatnonzero(fit)
                    at = at[best(scores[at], ids[span][at], k)]
                    for column, values in zip(out, ([query] * len(at), [query_id] * len(at), ids[span][at], scores[at].astype(np.int64)), strict=True):
                        column.extend(values)
            return pa.table([pa.array(c, pa.int64()) for c in out], names=["query", "query_id", "vec_id", "score"])

        by = ("cell", "slice", "block")
        to = queries.mapInArrow(visit, "cell long, slice long, block long, query long, query_id long, v binary, bound long")
        return self._dealt(blocks).groupBy(*by).cogroup(to.groupBy(*by)).applyInArrow(lambda rows, asked: find(rows, asked), "query long, query_id long, vec_id long, score long")


ORACLE = """
WITH ok AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.r <> c.r
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
