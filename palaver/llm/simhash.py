"""SimHash near-duplicates through vantage-point trees.

Each text gets a 64-bit fingerprint over its word shingles.  Distinct fingerprints are partitioned by a
vantage-point tree over the Hamming metric: a node holds a vantage fingerprint and a radius; what is
within the radius goes left, the rest right, and the leaves are shards.  A fingerprint is stored in its home
shard and sent as a query to every later shard that its search ball may overlap (triangle bounds: left
while d - r <= radius, right while d + r > radius).  Each shard searches a vantage-point tree of its own
points in the same way, so the pairs found are exactly those within ``max_distance`` bits.  A shard hands on a
spanning forest of its links, and large-star/small-star rounds join the forests into components.

What a hot group of near copies can cost is bounded: equal fingerprints are one point, and at most
C(64, 0..4) = 679,121 distinct points lie within 4 bits of any.

Edge cases: null texts count as empty; texts without words have fingerprint zero and link like others; fewer
words than a shingle form one shingle; null ids belong to a group but never name it unless all are null;
repeated rows stay rows of their own; a very long text is read whole and becomes one fingerprint; empty tables give no rows; further columns are ignored by
:func:`near_duplicate_groups` and pass through :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, fresh, materialize, text_or_empty

SEED = 42
SHINGLE = 4
MAX_DISTANCE = 4
#: Points that a shard is meant to hold (a fingerprint goes to about 1.7 times as many shards with each level
#: of the tree, so shards are large), levels that small inputs get for parallel work, and
#: fingerprints that the routing tree is fitted on at least.
SHARD_POINTS = 65_536
LEAST_DEPTH, LEAST_POINTS = 3, 2_048
TREE_SAMPLE = 32_768
LEAF = 384
BLOCK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_spans(words: list[bytes], size: int) -> tuple[bytes, list[int], list[int]]:
    """The space-joined words and the byte ranges of their shingles in it."""
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    size = min(size, len(words))
    return joined, starts[: len(starts) - size + 1], ends[size - 1 :]


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, starts, ends = shingle_spans(words, size)
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, fp): fp as a signed long; text_key tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_or_empty(text_col))).alias("text_key"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key binary, fp long"
    return rows.mapInArrow(run, schema)


# -- vantage-point trees --------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose_vantage(points: np.ndarray, r: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The candidate whose median split sends the fewest points to both sides; None if none splits."""
    best = None
    for v in rng.choice(points, min(8, len(points)), replace=False):
        d = distance(points, v)
        mu = int(np.median(d))
        inside = int((d <= mu).sum())
        if 0 < inside < len(points):
            both = int((np.abs(d - mu) <= r).sum())
            if best is None or both < best[0]:
                best = (both, v, mu)
    return best and (best[1], best[2])


def build_tree(points: np.ndarray, depth: int, r: int, rng: np.random.Generator):
    """Nested (vantage, radius, left, right); a leaf is None."""
    if depth <= 0 or len(points) < 4 or (chosen := choose_vantage(points, r, rng)) is None:
        return None
    v, mu = chosen
    near = distance(points, v) <= mu
    return (int(v), mu, build_tree(points[near], depth - 1, r, rng), build_tree(points[~near], depth - 1, r, rng))


def leaves(tree) -> int:
    return 1 if tree is None else leaves(tree[2]) + leaves(tree[3])


def route(tree, points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point index, shard, home): the home shard and the later shards whose region the ball overlaps."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node, idx: np.ndarray, home: np.ndarray, first: int) -> int:
        if node is None:
            out.append((idx, first, home))
            return first + 1
        v, mu, left, right = node
        d = distance(points[idx], np.uint64(v))
        go_left = np.where(home, d <= mu, d - r <= mu)
        after = walk(left, idx[go_left], home[go_left], first)
        # a point at home on the left may still find pairs on the right; what is at home on the right
        # is found by the earlier shards' points, so it is not sent back
        go_right = np.where(home & (d > mu), True, d + r > mu)
        return walk(right, idx[go_right], (home & (d > mu))[go_right], after)

    walk(tree, np.arange(len(points)), np.ones(len(points), bool), 0)
    return (
        np.concatenate([i for i, _, _ in out]),
        np.concatenate([np.full(len(i), s, np.int32) for i, s, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


class Forest:
    """Union-find over array positions, in batches of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            a, b = np.minimum(a, b), np.maximum(a, b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, b, a)

    def labels(self) -> np.ndarray:
        self.parent = self.roots(self.parent)
        return self.parent


def search(points: np.ndarray, n_home: int, r: int) -> np.ndarray:
    """Labels over *points* that link all pairs within r of which one is among the first n_home.

    The home points are the tree; all points are queries.
    """
    forest, rng = Forest(len(points)), np.random.default_rng(SEED)

    def brute(p: np.ndarray, q: np.ndarray) -> None:
        for i in range(0, len(p), 1024):
            part = points[p[i : i + 1024]]
            for j in range(0, len(q), 512):
                hit, by = np.nonzero(np.bitwise_count(part[:, None] ^ points[q[j : j + 512]][None, :]) <= r)
                if len(hit):
                    forest.join(p[i + hit], q[j + by])

    todo = [(np.arange(n_home), np.arange(len(points)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        chosen = choose_vantage(points[p], r, rng) if len(p) > LEAF else None
        if chosen is None:
            brute(p, q)
            continue
        v, mu = chosen
        dp, dq = distance(points[p], v), distance(points[q], v)
        todo.append((p[dp <= mu], q[dq - r <= mu]))
        todo.append((p[dp > mu], q[dq + r > mu]))
    return forest.labels()


# -- links and components -------------------------------------------------------------------------


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, shard_points: int = SHARD_POINTS, sample: int = TREE_SAMPLE) -> DataFrame:
    """(a, b) with a > b: a spanning forest, per shard, of all pairs of fingerprints within max_distance."""
    spark = distinct.sparkSession
    n = distinct.count()
    levels = lambda size: int(np.ceil(np.log2(max(1, n / size))))
    depth = max(levels(shard_points), min(LEAST_DEPTH, levels(min(LEAST_POINTS, shard_points))))
    fitted = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(max(sample, 8 << depth)).collect()  # bounded
    points = np.array([x[0] for x in fitted], np.int64).view(np.uint64)
    tree = build_tree(points, depth, max_distance, np.random.default_rng(SEED))
    held = spark.sparkContext.broadcast(tree)  # 2^depth nodes: n / shard_points of them

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 8192):
                part = fps[at : at + 8192]
                idx, shard, home = route(held.value, part, max_distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(part[idx].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"]
                )

    def find(pdf):
        import pandas as pd

        home = pdf["home"].to_numpy()
        fps = pdf["fp"].to_numpy()
        fps = np.concatenate([fps[home], fps[~home]])
        label = search(fps.view(np.uint64), int(home.sum()), max_distance)
        other = label != np.arange(len(fps))
        a, b = fps[other], fps[label[other]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    found = dealt.groupBy("shard").applyInPandas(find, "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b), a > b, the smallest node of its component.

    Large-star and small-star rounds; a round is two aggregations and two joins over the edges, and the
    number of rounds grows with the logarithm of the longest path.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = materialize(edges.select("a", "b"))
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a hang below the least of its neighbourhood
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
        large = up.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours hang below the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = materialize(small.filter("a <> b").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicate_groups(
    docs: DataFrame, size: int = SHINGLE, max_distance: int = MAX_DISTANCE, text_col: str = "text", id_col: str = "doc_id",
    shard_points: int = SHARD_POINTS, similarity: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id (the smallest id of its group).

    With *similarity*, texts whose shingle sets have that Jaccard similarity or more are linked too.
    """
    rows = materialize(fingerprints(docs, size, text_col, id_col))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(distinct, max_distance, shard_points)
    if similarity is not None:
        from palaver.llm import shingle_join  # it builds on this module

        scratch = Scratch(docs.sparkSession)
        found = scratch.write(found)
        texts = docs.select(F.unhex(F.md5(text_or_empty(text_col))).alias("text_key"), text_or_empty(text_col).alias("text"))
        keys = rows.select("text_key", "fp")
        found = materialize(found.unionByName(shingle_join.similar_links(texts, keys, size, similarity, found, scratch)).distinct())
        scratch.remove()
    labels = components(found)
    linked = labels.join(distinct, labels["node"] == distinct["fp"]).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("named"))
    of_fp = linked.join(named, "root").select(F.col("fp").alias("l_fp"), "named")
    per_fp = distinct.join(of_fp, F.col("fp") == F.col("l_fp"), "left").select(
        F.col("fp").alias("p_fp"), F.coalesce("named", "least").alias("component_id")
    )
    # written, so that the last join reads two plain shuffles and a hot fingerprint's rows can be split
    per_fp = materialize(per_fp)
    return rows.join(per_fp, F.col("fp") == F.col("p_fp")).drop("p_fp")


def drop_near_duplicates(
    docs: DataFrame, size: int = SHINGLE, max_distance: int = MAX_DISTANCE, text_col: str = "text", id_col: str = "doc_id",
    similarity: float | None = None,
) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Where several rows of a group share that id, the one with the smallest text digest stays, once.
    """
    groups = near_duplicate_groups(docs, size, max_distance, text_col, id_col, similarity=similarity)
    # a group whose ids are all null is told by its fingerprints' name, null: those rows form one group
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(
        F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("rows")
    )
    d = fresh("__text_key", docs)
    keyed = docs.withColumn(d, F.unhex(F.md5(text_or_empty(text_col))))
    i, t = fresh("__kept_id", keyed), fresh("__kept_key", keyed)
    kept = materialize(kept.select(F.col("doc_id").alias(i), F.col("text_key").alias(t), "rows"))
    same = lambda k: keyed[id_col].eqNullSafe(k[i]) & (keyed[d] == k[t])
    once, repeated = kept.filter("rows = 1"), kept.filter("rows > 1")
    single = keyed.join(once, same(once), "left_semi")
    again = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, d])
    return single.unionByName(again).drop(d)
