"""Queries against vectors in block products.

Queries and vectors that may meet (all, or those of one session) form a group.  A group's vectors are dealt by a hash of their
id to parts of about ``ROWS`` (``ROWS_OF_ALL`` where all pairs are wanted), its queries to blocks of at most about ``BLOCK``, and each block meets each part in one task, as products
of two matrices.  So neither side is ever held whole, and what is shuffled is a part once a block of queries.  For the best k a
task keeps k rows a query, and what a product finds near the k-th best is scored once more row by row, so that equal vectors
score alike wherever they stand; equal scores are ordered by event_id.  The work is that of all pairs, at the speed of a
matrix product.

Vectors without a norm (cosine), with a null or without a finite number, and of another length than the query's are no
neighbours of anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.vector import rows_of

#: Vectors of a part, queries of a block, best rows that a block keeps, rows of one product, pairs that are scored or handed on at a time.
ROWS, ROWS_OF_ALL, BLOCK, HELD, STEP, AT_ONCE = 20_000, 4000, 2048, 250_000, 2048, 1 << 16
#: Room for rounding, relative to the size of what is added up.
SLACK = 1e-9
KEY = ("g", "width", "salt", "block")


def dealt(queries: DataFrame, rows: DataFrame, block: int, most: int) -> DataFrame:
    """(g, width, salt, block, q, v, vector) of queries (g, q, vector) and rows (g, v, vector), parts together and their queries first."""
    kinds = {dict(queries.dtypes)["vector"], dict(rows.dtypes)["vector"]}
    kind = kinds.pop() if len(kinds) == 1 else "array<double>"
    sized = [d.withColumns({"vector": F.col("vector").cast(kind), "width": F.size("vector")}).filter("g IS NOT NULL AND width > 0") for d in (queries, rows)]
    many = lambda d, n, name: d.groupBy("g", "width").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    parts = many(sized[0], block, "blocks").join(many(sized[1], most, "salts"), ["g", "width"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    none = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    asked = sized[0].join(parts, ["g", "width"]).withColumn("block", at("q.query_id", "blocks")).withColumn("salt", each("salts"))
    given = sized[1].join(parts, ["g", "width"]).withColumn("salt", at("v.event_id", "salts")).withColumn("block", each("blocks"))
    both = asked.select(*KEY, F.lit(0).alias("side"), "q", none(rows, "v"), "vector").unionByName(given.select(*KEY, F.lit(1).alias("side"), none(queries, "q"), "v", "vector"))
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "side").select(*KEY, "side", "q", "v", "vector")


class Part:
    """A block of queries against the vectors of a part."""

    def __init__(self, width: int, k: int | None, metric: str, modes: Sequence[tuple[float, ...]], terms: Sequence[int], others: tuple[int, int] | None):
        self.width, self.k, self.metric, self.modes, self.terms, self.others = width, k, metric, modes, terms, others
        self.asked: list[pa.Array] = []
        self.raw: list[np.ndarray] = []
        self.queries: np.ndarray | None = None
        self.held: tuple | None = None  # query, mode, similarity, score, row of the best so far
        self.fresh: list[tuple] = []

    def ask(self, q: pa.Array, vector: pa.Array) -> None:
        good, matrix = rows_of(vector, self.width)
        has = np.flatnonzero((matrix != 0).any(axis=1)) if self.metric == "cosine" else np.arange(len(matrix))
        self.asked.append(q.take(pa.array(good[has])))
        self.raw.append(matrix[has])

    def start(self) -> None:
        self.queries, self.ids = np.concatenate(self.raw), pa.concat_arrays(self.asked)
        squares = (self.queries * self.queries).sum(axis=1)
        self.norms, self.squares = np.sqrt(squares), squares
        self.left = self.queries / self.norms[:, None] if self.metric == "cosine" else self.queries
        self.limit = np.full((len(self.modes), len(self.queries)), -np.inf)
        if self.others:
            own = self.ids.flatten()[self.others[0]]
            self.sessions = pc.unique(own)
            self.session = pc.index_in(own, self.sessions).to_numpy(zero_copy_only=False)

    def meet(self, v: pa.Array, vector: pa.Array) -> Iterator[pa.RecordBatch]:
        """Pairs at once (k of None), else none until the end."""
        if self.queries is None:
            if not self.asked:
                return
            self.start()
        good, matrix = rows_of(vector, self.width)
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        if self.metric == "cosine":
            has = np.flatnonzero(norms > 0)
            good, matrix, norms = good[has], matrix[has], norms[has]
        if not len(good) or not len(self.queries):
            return
        step = STEP if self.k else max(1, AT_ONCE // len(self.queries))
        for a in range(0, len(good), step):
            at = slice(a, a + step)
            rows = v.take(pa.array(good[at]))
            if self.k:
                self.score(rows, matrix[at], norms[at])
            else:
                yield self.pairs(rows, matrix[at], norms[at])

    def exact(self, i: np.ndarray, j: np.ndarray, matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Similarities of pairs, row by row."""
        if self.metric == "l2":
            return 1 / (1 + np.sqrt(((matrix[j] - self.queries[i]) ** 2).sum(axis=1)))
        return (matrix[j] * self.queries[i]).sum(axis=1) / (norms[j] * self.norms[i])

    def pairs(self, rows: pa.Array, matrix: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
        if self.metric == "l2":
            i, j = (x.ravel() for x in np.indices((len(self.queries), len(rows))))
            similarity = np.concatenate([self.exact(i[s : s + AT_ONCE], j[s : s + AT_ONCE], matrix, norms) for s in range(0, len(i), AT_ONCE)])
        else:
            similarity = (self.left @ (matrix / norms[:, None]).T).ravel()
            i, j = np.repeat(np.arange(len(self.queries)), len(rows)), np.tile(np.arange(len(rows)), len(self.queries))
        return batch_of(self.ids.take(pa.array(i)), rows.take(pa.array(j)), np.zeros(len(i), np.int32), similarity, similarity)

    def score(self, rows: pa.Array, matrix: np.ndarray, norms: np.ndarray) -> None:
        fields = rows.flatten()
        terms = [fields[t].to_numpy(zero_copy_only=False).astype(np.float64) for t in self.terms]
        if self.metric == "l2":
            near = 2 * (self.left @ matrix.T) - (norms * norms)[None, :] - self.squares[:, None]  # of the negated squared distance
            room = SLACK * (1 + self.squares + (norms * norms).max())
        else:
            near, room = self.left @ (matrix / norms[:, None]).T, np.full(len(self.queries), SLACK)
        if self.others:
            sessions = fields[self.others[1]]
            of = pc.fill_null(pc.index_in(sessions, self.sessions), -1).to_numpy(zero_copy_only=False)
            near[(of[None, :] == self.session[:, None]) | np.asarray(sessions.is_null())[None, :]] = -np.inf
        for m, weights in enumerate(self.modes):
            base = np.zeros(len(rows))
            for w, t in zip(weights[1:], terms, strict=True):
                base = base + w * t
            keys = near if self.metric == "l2" or not self.terms else weights[0] * near + base[None, :]
            limit, slack = self.limit[m], room * (1 + sum(map(abs, weights)) + np.abs(base).max())
            if len(rows) > self.k and np.isneginf(limit).any():
                limit = np.maximum(limit, np.partition(keys, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
            i, j = np.nonzero((keys >= (limit - slack)[:, None]) & (keys > -np.inf))
            for s in range(0, len(i), AT_ONCE):
                a, b = i[s : s + AT_ONCE], j[s : s + AT_ONCE]
                similarity = self.exact(a, b, matrix, norms)
                score = similarity
                if self.terms:
                    score = weights[0] * similarity
                    for w, t in zip(weights[1:], terms, strict=True):
                        score = score + w * t[b]
                self.fresh.append((a, np.full(len(a), m), similarity, score, rows.take(pa.array(b))))
                if sum(len(f[0]) for f in self.fresh) >= AT_ONCE:
                    self.merge()
        if np.isneginf(self.limit).any():
            self.merge()

    def merge(self) -> None:
        """The best k of each query and mode of what is held and what is fresh; sets the limits that further rows have to reach."""
        parts = [*([self.held] if self.held else []), *self.fresh]
        self.fresh = []
        if not parts:
            return
        i, m, similarity, score = (np.concatenate([p[c] for p in parts]) for c in range(4))
        rows = pa.concat_arrays([p[4] for p in parts])
        ids = pc.rank(rows.field(rows.type.get_field_index("event_id")), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((ids, -score, m, i))
        group = i[order] * len(self.modes) + m[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[place < self.k]
        self.held = i[kept], m[kept], similarity[kept], score[kept], rows.take(pa.array(kept))
        last = order[place == self.k - 1]
        self.limit[m[last], i[last]] = -((1 / score[last] - 1) ** 2) if self.metric == "l2" and not self.terms else score[last]

    def best(self) -> pa.RecordBatch | None:
        if self.queries is None or not self.k:
            return None
        self.merge()
        if not self.held or not len(self.held[0]):
            return None
        i, m, similarity, score, rows = self.held
        return batch_of(self.ids.take(pa.array(i)), rows, m.astype(np.int32), similarity, score)


def batch_of(q: pa.Array, v: pa.Array, mode: np.ndarray, similarity: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([q, v, pa.array(mode), pa.array(similarity), pa.array(score)], names=["q", "v", "mode", "similarity", "score"])


def met(queries: DataFrame, rows: DataFrame, k: int | None, metric: str = "cosine", others: tuple[str, str] | None = None, terms: Sequence[str] = (), modes: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(columns of q, columns of v, mode, similarity, score) of queries (g, q, vector) and rows (g, v, vector) of one group, q and v being structs.

    *k* of None: all pairs.  Else of each task's parts the best k a query, so :func:`top_k` has to follow.  *terms* are numbers of v, *modes* weights
    of the similarity and of these; the score is their sum in this order (*terms* need cosines).  *others*: fields of q and v that have to differ.
    """
    if terms and metric != "cosine":
        raise ValueError("terms are added to cosines only")
    asked, given = queries.schema["q"].dataType, rows.schema["v"].dataType
    names, weights = list(modes or {"": (1.0,)}), list((modes or {"": (1.0,)}).values())
    at, differ = [given.names.index(t) for t in terms], others and (asked.names.index(others[0]), given.names.index(others[1]))
    block = max(64, min(BLOCK, HELD // (k * len(names)))) if k else BLOCK

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, where = None, None
        for batch in batches:
            g, rest = batch.column(0), np.stack([batch.column(c).to_numpy() for c in range(1, 5)], axis=1)  # width, salt, block, side
            new = (rest[1:] != rest[:-1]).any(axis=1) | pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rest)] if len(rest) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = (g[a].as_py(), *rest[a][:3].tolist())
                if here != where:
                    if part is not None and (found := part.best()) is not None:
                        yield found
                    part, where = Part(here[1], k, metric, weights, at, differ), here
                vector = batch.column(7).slice(a, b - a)
                if rest[a][3] == 0:
                    part.ask(batch.column(5).slice(a, b - a), vector)
                else:
                    yield from part.meet(batch.column(6).slice(a, b - a), vector)
        if part is not None and (found := part.best()) is not None:
            yield found

    shape = f"q {asked.simpleString()}, v {given.simpleString()}, mode int, similarity double, score double"
    found = dealt(queries, rows, block, ROWS if k else ROWS_OF_ALL).mapInArrow(search, shape)
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("mode") + 1)
    return found.select("q.*", "v.*", named.alias("mode"), "similarity", "score")
