"""Exact nearest neighbours with pruning by pivots.

Vectors live in a space in which nearer is better: for the cosine similarity that of unit vectors, else their own.  An
index gives each vector the nearest of at most ``MOST_PIVOTS`` pivots, its cell, and its distance to it.  For a query q at
distance d from a cell's pivot, a vector x of that cell at distance e is no nearer than |d - e|.  So with an upper bound r
of the distance of the k-th best,

- cells whose ring of distances lies outside [d - r, d + r] are not read at all,
- of the cells read, runs of rows sorted by e that no query's ring touches are passed over, and
- the others meet all queries of the cell in one block product.

The bound comes from a first round, in which a query meets the nearest cells that hold k vectors; the second round meets
the cells that the bound leaves.  Both rounds are one shuffle of the cells asked for, dealt by cell and salt: a cell of more
than ``CELL_ROWS`` vectors is salted, the queries of a cell come in blocks of ``BLOCK``, and a task keeps k rows a query and
cell.  Nothing is approximate: pruning uses the triangle inequality with room for rounding, candidates are scored once more
row by row in double precision, and equal scores are ordered by id.

Pivots are chosen by farthest-first traversal of a bounded sample (``SAMPLE`` rows by hash of the id); every row is indexed,
and the sample decides only how much is pruned.  Vectors without a norm (cosine), null vectors and vectors of another length
than the first pivot's are no neighbours of anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.vector import rows_of
from palaver.operators.graph import cut
from palaver.operators.retrieval import top_k

#: Pivots at most, rows that they are chosen from, vectors that one task reads of a cell, queries that it holds.
MOST_PIVOTS, SAMPLE, CELL_ROWS, BLOCK = 256, 8192, 50_000, 2048
#: Room for rounding in bounds.
SLACK = 1e-7


def in_space(matrix: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a place, places)."""
    if metric == "l2":
        return np.arange(len(matrix)), matrix
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    has = np.flatnonzero(norms > 0)
    return has, matrix[has] / norms[has, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of a and of b, by one product."""
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def choose_pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each pivot is the point farthest from those before it."""
    if not len(points):
        return points
    chosen, gap = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < most and gap.max() > SLACK:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


@dataclass
class Index:
    """Vectors by cell: columns of the vectors, ``cell``, ``dist``; and what is known of each cell."""

    rows: DataFrame
    pivots: np.ndarray
    metric: str
    #: cell -> (least and largest distance, vectors); at most MOST_PIVOTS
    cells: dict[int, tuple[float, float, int]]

    def salts(self, cell: int) -> int:
        return max(1, -(-self.cells[cell][2] // CELL_ROWS))


def build_index(vectors: DataFrame, metric: str = "cosine", most: int = MOST_PIVOTS, sample: int = SAMPLE) -> Index:
    """Index *vectors* (event_id, embedding, more); its rows are written once, to the shared folder."""
    taken = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64("event_id"), "event_id").limit(sample).select("embedding").toPandas()["embedding"]
    width = len(taken.iloc[0]) if len(taken) else 0
    points = np.array([v for v in taken if len(v) == width], dtype=np.float64).reshape(len(taken) and -1, width)
    points = in_space(points[np.isfinite(points).all(axis=1)], metric)[1]
    n = vectors.count()
    pivots = choose_pivots(points, min(most, max(1, math.isqrt(n))))
    place = vectors.columns.index("embedding")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(pivots):
                continue
            good, matrix = rows_of(batch.column(place), width)
            has, points = in_space(matrix, metric)
            if not len(has):
                continue
            far = distances(points, pivots)
            cell = far.argmin(axis=1)
            exact = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
            kept = batch.take(pa.array(good[has]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array(exact)], names=[*kept.schema.names, "cell", "dist"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "cell int", "dist double"])
    rows = cut(vectors.mapInArrow(assign, schema))
    known = rows.groupBy("cell").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect()  # a row a pivot
    return Index(rows, pivots, metric, {r[0]: (r[1], r[2], r[3]) for r in known})


Chooser = Callable[[np.ndarray, np.ndarray], np.ndarray]


def deal(queries: DataFrame, index: Index, choose: Chooser) -> DataFrame:
    """(cell, query_id, q_session, query, bound): queries (with a bound, infinite at first) at the cells that *choose* picks.

    *choose* gets the queries' distances to all known cells and their bounds and returns a boolean matrix.
    """
    cells = np.array(sorted(index.cells), dtype=np.int64)
    centers, metric = index.pivots[cells] if len(cells) else index.pivots, index.metric

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(cells):
                continue
            good, matrix = rows_of(batch.column(2), centers.shape[1])
            has, points = in_space(matrix, metric)
            if not len(has):
                continue
            kept = batch.take(pa.array(good[has]))
            bounds = kept.column(3).to_numpy(zero_copy_only=False)
            at, which = np.nonzero(choose(distances(points, centers), bounds))
            yield pa.RecordBatch.from_arrays([pa.array(cells[which], pa.int32()), *kept.take(pa.array(at)).columns], names=["cell", *kept.schema.names])

    kinds = dict(queries.dtypes)
    schema = f"cell int, query_id {kinds['query_id']}, q_session {kinds['q_session']}, query {kinds['query']}, bound double"
    return queries.select("query_id", "q_session", "query", "bound").mapInArrow(pick, schema)


def meet(asked: DataFrame, index: Index, k: int, others_only: bool) -> DataFrame:
    """(query_id, event_id, session_id, similarity): of each query the k best of each cell part that it is dealt to."""
    spark = asked.sparkSession
    metric, pivots = index.metric, index.pivots
    asked = cut(asked)
    salts = spark.createDataFrame([(c, index.salts(c)) for c in index.cells] or [(-1, 1)], "cell int, salts int")  # a row a pivot
    blocks = asked.groupBy("cell").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).cast("int").alias("blocks")).join(F.broadcast(salts), "cell")
    blocks = F.broadcast(cut(blocks))  # a row a pivot
    block, salt = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("event_id"), F.col("salts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(blocks, "cell").withColumn("salt", salt).withColumn("block", each("blocks"))
    probes = asked.join(blocks, "cell").withColumn("block", block).withColumn("salt", each("salts"))
    event, session, query, q_session = (dict(index.rows.dtypes)["event_id"], dict(index.rows.dtypes)["session_id"], dict(asked.dtypes)["query_id"], dict(asked.dtypes)["q_session"])
    vector = lambda c: F.col(c).cast("array<double>").alias("vector")
    key = [F.col("cell"), F.col("salt"), F.col("block")]
    none = lambda t: F.lit(None).cast(t)
    both = probes.select(*key, F.lit(-1.0).alias("dist"), "bound", F.col("query_id"), F.col("q_session"), none(event).alias("event_id"), none(session).alias("session_id"), vector("query")).unionByName(
        rows.select(*key, "dist", F.lit(0.0).alias("bound"), none(query).alias("query_id"), none(q_session).alias("q_session"), "event_id", "session_id", vector("embedding"))
    )
    dealt = both.repartition("cell", "salt", "block").sortWithinPartitions("cell", "salt", "block", "dist")
    out = f"query_id {query}, event_id {event}, session_id {session}, similarity double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Part | None = None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held is None or held.where != tuple(where[a]):
                    if held is not None and (found := held.best(schema)) is not None:
                        yield found
                    held = Part(tuple(where[a]), pivots, metric, k, others_only)
                held.take(batch.slice(a, b - a))
        if held is not None and (found := held.best(schema)) is not None:
            yield found

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], out).schema)
    return dealt.select("cell", "salt", "block", "dist", "bound", "query_id", "q_session", "event_id", "session_id", "vector").mapInArrow(search, out)


class Part:
    """One block of queries against the vectors of one part of a cell, which come sorted by their distance to its pivot."""

    def __init__(self, where: tuple, pivots: np.ndarray, metric: str, k: int, others_only: bool):
        self.where, self.pivot, self.metric, self.k, self.others_only = where, pivots[int(where[0])], metric, k, others_only
        self.ids: list = []
        self.sessions: list = []
        self.bounds: list[float] = []
        self.raw: list[np.ndarray] = []
        self.queries: np.ndarray | None = None
        self.found: list[list[tuple]] = []  # of each query (negated similarity, event, session), k at most
        self.passed_over = 0

    def take(self, batch: pa.RecordBatch) -> None:
        dist = batch.column(3).to_numpy()
        _, matrix = rows_of(batch.column(9), len(self.pivot))
        n = int(np.searchsorted(dist, 0.0))  # queries come first
        if n:
            self.ids += batch.column(5).slice(0, n).to_pylist()
            self.sessions += batch.column(6).slice(0, n).to_pylist()
            self.bounds += batch.column(4).slice(0, n).to_pylist()
            self.raw.append(matrix[:n])
        if n < len(dist) and self.ids:
            if self.queries is None:
                self.start()
            self.score(batch.slice(n), dist[n:], matrix[n:])

    def start(self) -> None:
        self.matrix = np.concatenate(self.raw)
        self.queries = in_space(self.matrix, self.metric)[1]
        self.norms = np.sqrt((self.matrix * self.matrix).sum(axis=1))
        self.at = distances(self.queries, self.pivot[None, :])[:, 0]
        self.limit = np.array(self.bounds)
        self.found = [[] for _ in self.ids]

    def score(self, batch: pa.RecordBatch, dist: np.ndarray, matrix: np.ndarray) -> None:
        near = np.flatnonzero((self.at - self.limit - SLACK <= dist[-1]) & (self.at + self.limit + SLACK >= dist[0]))
        if not len(near):
            self.passed_over += len(dist)
            return
        places = in_space(matrix, self.metric)[1]
        far = distances(self.queries[near], places)
        events, sessions = batch.column(7).to_pylist(), batch.column(8).to_pylist()
        turn = np.empty(len(events), np.int64)  # the order of the ids, which decides ties
        turn[sorted(range(len(events)), key=events.__getitem__)] = np.arange(len(events))
        for i, row in zip(near.tolist(), far, strict=True):
            limit = self.limit[i] + SLACK
            if len(row) > self.k and not self.others_only:
                limit = min(limit, np.partition(row, self.k - 1)[self.k - 1] + SLACK)
            hits = np.flatnonzero(row <= limit)
            if self.others_only:
                hits = hits[[sessions[h] is not None and sessions[h] != self.sessions[i] for h in hits]]
            if not len(hits):
                continue
            # row by row, so equal vectors score alike wherever they stand
            if self.metric == "l2":
                score = 1 / (1 + np.sqrt(((matrix[hits] - self.matrix[i]) ** 2).sum(axis=1)))
            else:
                v = matrix[hits]
                score = (v * self.matrix[i]).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * self.norms[i])
            few = np.lexsort((turn[hits], -score))[: self.k]
            more = [(-score[j], events[hits[j]], sessions[hits[j]]) for j in few]
            best = self.found[i] = sorted(self.found[i] + more, key=lambda r: r[:2])[: self.k]
            if len(best) == self.k:
                worst = -best[-1][0]
                away = 1 / worst - 1 if self.metric == "l2" else math.sqrt(max(0.0, 2 - 2 * worst))
                self.limit[i] = min(self.limit[i], away + SLACK)

    def best(self, schema: pa.Schema) -> pa.RecordBatch | None:
        rows = [(q, e, s, -score) for q, found in zip(self.ids, self.found, strict=False) for score, e, s in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else None


def nearest_cells(index: Index, k: int) -> Chooser:
    """The nearest cells that together hold k vectors."""
    sizes = np.array([index.cells[c][2] for c in sorted(index.cells)])

    def choose(far: np.ndarray, _: np.ndarray) -> np.ndarray:
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        picked = np.zeros(far.shape, bool)
        np.put_along_axis(picked, order, before < k, axis=1)
        return picked

    return choose


def cells_left(index: Index, k: int) -> Chooser:
    """Further cells whose ring of distances comes within the bound."""
    rings = np.array([index.cells[c][:2] for c in sorted(index.cells)]).reshape(-1, 2)
    first = nearest_cells(index, k)

    def choose(far: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        reach = bounds[:, None] + SLACK
        return (far - reach <= rings[:, 1]) & (far + reach >= rings[:, 0]) & ~first(far, bounds)

    return choose


def with_bounds(queries: DataFrame, first: DataFrame, k: int, metric: str) -> DataFrame:
    """Queries with the distance of their k-th best of a first round; infinite where it found fewer."""
    kth = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("similarity"))).alias("kth"))
    away = 1 / F.col("kth") - 1 if metric == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth")))
    bound = kth.filter("kth IS NOT NULL").select("query_id", away.alias("bound"))
    return queries.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))


def search(queries: DataFrame, index: Index, k: int, others_only: bool = False) -> DataFrame:
    """The exact k best vectors of each query (query_id, q_session, query): query_id, event_id, session_id, similarity, rank.

    *others_only*: of other sessions than the query's (J12).
    """
    if "q_session" not in queries.columns:
        queries = queries.withColumn("q_session", F.lit(None).cast(dict(index.rows.dtypes)["session_id"]))
    start = deal(queries.withColumn("bound", F.lit(math.inf)), index, nearest_cells(index, k))
    first = cut(top_k(meet(start, index, k, others_only), k))
    rest = deal(with_bounds(queries, first, k, index.metric), index, cells_left(index, k))
    return top_k(first.drop("rank").unionByName(meet(rest, index, k, others_only)), k)
