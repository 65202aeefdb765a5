"""Links between texts whose sets of word shingles have a Jaccard similarity of a threshold or more, exactly.

Prefix filter: in any fixed order of all shingles, two sets that are t alike share one of the first n - ceil(t n) + 1
of each.  The order puts shingles that a sample finds common last, so that few texts meet under one shingle; the order
decides the cost alone, never the result.  Texts that meet are candidates if their sizes and the places of the shingle in
both allow (what follows the first shared one bounds the overlap), and every candidate is verified: bitmaps rule out
most, the whole sets decide the rest.

Members of a bucket (the texts that hold one shingle in their prefix) are first compared with one of them only, its
centre: the one with the smallest share of shingles that are not common.  In a group of edited copies that is the text
with the fewest edits of its own, as a rule what they were copied from, and it is the same one in most of the group's
buckets.  What these links and the given ones join needs no more comparing, so a bucket of near copies costs as many
comparisons as it has members.  Only in buckets whose members are still apart are they compared pair by pair across the
groups, and there classes of one size and place meet first: texts that share a common passage and little else form a
bucket in which no two classes allow a link, and no pair of them is made.

A bucket that the sample finds large is split: its members are dealt to parts by fingerprint, compared with their
part's centre, and the parts' centres with that of the bucket.  Copies of a text are dropped where they are read, task
by task, and again in the bucket.

Texts are told by fingerprint, as in :mod:`palaver.llm.simhash`: texts with one fingerprint are linked already.
Texts without words are in no bucket.  A very long text is in as many buckets as its prefix has shingles, and its set is read
whole where it is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm import simhash
from palaver.llm.common import Scratch

#: Rows up to which all are read for the order of shingles, the share of more (one in so many), the count in the
#: sample from which a shingle is common, and the common shingles kept at most (the others count as rare).
SAMPLE_ALL, SAMPLE_ONE_IN, COMMON_FROM, MOST_COMMON = 20_000, 8, 3, 200_000
#: Members of a bucket that a part is meant to hold.
PART_MEMBERS = 20_000
#: Keys of texts to verify that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bits of the bitmaps that rule out pairs.
PARITY_BITS = 1024
#: Digests of texts that a task remembers to drop copies, and entries that it hands on together.
SEEN_TEXTS, ENTRIES = 50_000, 100_000
EPS = 1e-9


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hash of every shingle, as in :func:`simhash.fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends = simhash.shingle_spans(words, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], simhash.SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, size).view(np.int64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.BLOCK):
        raw = np.ascontiguousarray(hashes[at : at + simhash.BLOCK].astype(">u8")).view(np.uint8)
        counts += np.unpackbits(raw).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


class Seen:
    """Tells a task which texts it has met, so that copies cost little; it forgets when it is full."""

    def __init__(self):
        self.keys: set[bytes] = set()

    def new(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= SEEN_TEXTS:
            self.keys.clear()
        self.keys.add(key)
        return True


def prefix_length(n: int, threshold: float) -> int:
    return n - ceil(threshold * n - EPS) + 1


def common_shingles(texts: DataFrame, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, estimated count) of the shingles that are common in a sample, by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size))], names=["token"])

    one_in = 1 if rows <= SAMPLE_ALL else SAMPLE_ONE_IN
    part = texts if one_in == 1 else texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(one_in)) == 0)
    counted = part.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counted.filter(F.col("n") >= COMMON_FROM).orderBy(F.col("n").desc(), "token").limit(MOST_COMMON).toArrow()  # bounded
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order] * one_in


def entries(texts: DataFrame, size: int, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, part, fp, rare, n, p): the first shingles of each text with its fingerprint; large buckets have parts from 1, others part 0.

    rare: how many of a thousand shingles of the text are not common; n: its shingles; p: the place of this one, from 1.
    """
    held = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value
        parts = -(-counts // PART_MEMBERS) if len(known) else counts
        seen, out = Seen(), []

        def flush():
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["token", "part", "fp", "rare", "n", "p"])

        waiting = 0
        for b in batches:
            for key, t in zip(b.column("text_key").to_pylist(), b.column("text"), strict=True):
                if not seen.new(key):
                    continue
                hashes = shingle_hashes(t.as_py(), size)
                if not len(hashes):
                    continue
                tokens, fp = np.unique(hashes.view(np.int64)), fingerprint_of(hashes)
                rank, part = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    met = known[at] == tokens
                    rank = np.where(met, counts[at], 0)
                    part = np.where(met & (parts[at] > 1), 1 + (((fp * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 40) % np.maximum(parts[at], 1), 0).astype(np.int32)
                first = np.lexsort((tokens, rank))[: prefix_length(len(tokens), threshold)]
                rare = int((rank == 0).sum()) * 1000 // len(tokens)
                out.append((tokens[first], part[first], np.full(len(first), fp, np.int64), *(np.full(len(first), x, np.int32) for x in (rare, len(tokens))), np.arange(1, len(first) + 1, dtype=np.int32)))
                waiting += len(first)
                if waiting >= ENTRIES:
                    yield flush()
                    waiting = 0
        if out:
            yield flush()

    return texts.select("text_key", "text").mapInArrow(run, "token long, part int, fp long, rare int, n int, p int")


def shared_buckets(all_entries: DataFrame, split: bool) -> DataFrame:
    """(token, fp, rare, n, p, mid): members of buckets of several texts, each once, and the centre (rare, fp, n, p) of their part.

    Where buckets are split, all their members stay, as they may meet those of other parts.
    """
    bucket = W.partitionBy("token", "part")
    ordered = bucket.orderBy("rare", "fp")
    rows = all_entries.withColumns(
        {"mid": F.min(F.struct("rare", "fp", "n", "p")).over(bucket), "lo": F.min("fp").over(bucket), "hi": F.max("fp").over(bucket), "before": F.lag("fp").over(ordered)}
    )
    several = F.col("lo") < F.col("hi")
    if split:
        several = several | (F.col("part") > 0)
    return rows.filter(several & (F.col("before").isNull() | (F.col("before") != F.col("fp")))).select("token", "fp", "rare", "n", "p", "mid")


def allowed(n: str, p: str, m: str, q: str, threshold: float):
    """Sets of n and m shingles whose first shared one is at places p and q may be *threshold* alike."""
    sizes = F.least(n, m) >= F.greatest(n, m) * threshold - EPS
    left = 1 + F.least(F.col(n) - F.col(p), F.col(m) - F.col(q))
    return sizes & (left >= (F.col(n) + F.col(m)) * (threshold / (1 + threshold)) - EPS)


def stars(shared: DataFrame, split: bool, threshold: float) -> DataFrame:
    """(token, a, b, may): members with the centre of their part, and these with that of the bucket; may: they can be alike."""

    def pairs(rows: DataFrame) -> DataFrame:
        rows = rows.select("token", "fp", "n", "p", F.col("mid.fp").alias("fq"), F.col("mid.n").alias("m"), F.col("mid.p").alias("q")).filter("fp <> fq")
        return rows.select("token", F.greatest("fp", "fq").alias("a"), F.least("fp", "fq").alias("b"), allowed("n", "p", "m", "q", threshold).alias("may"))

    out = pairs(shared)
    if split:
        top = shared.filter("fp = mid.fp").withColumn("mid", F.min(F.struct("rare", "fp", "n", "p")).over(W.partitionBy("token")))
        out = out.unionByName(pairs(top))
    return out


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap in which every shingle flips one bit: two sets differ in at least as many shingles as their bitmaps in bits."""
    bits = np.bincount((tokens.view(np.uint64) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def parities_of(texts: DataFrame, size: int) -> DataFrame:
    """(fp, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            b = b.filter(pa.array(map(seen.new, b.column("text_key").to_pylist()), pa.bool_()))
            sets = [shingle_set(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("fp"), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary())], names=["fp", "n", "bits"]
            )

    return texts.select("text_key", "fp", "text").mapInArrow(run, "fp long, n int, bits binary")


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(fp, tokens): the set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            b = b.filter(pa.array(map(seen.new, b.column("text_key").to_pylist()), pa.bool_()))
            sets = [shingle_set(t.as_py(), size).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(sets, pa.binary())], names=["fp", "tokens"])

    return texts.select("text_key", "fp", "text").mapInArrow(run, "fp long, tokens binary")


def within(pairs: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose other columns satisfy *test*, without these columns; bytes are read in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = {n: b.column(n) for n in b.schema.names if n not in ("a", "b")}
            keep = pa.array([test({n: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for n, c in rest.items()}) for i in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(keep)

    return pairs.mapInArrow(run, "a long, b long")


def of_pairs(pairs: DataFrame, texts: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(text_key, fp, text) of the pairs' fingerprints."""
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    wanted = scratch.write(keys.join(ends, "fp", "left_semi").distinct())
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "text_key")


def verified(pairs: DataFrame, texts: DataFrame, keys: DataFrame, size: int, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of fingerprints of which some texts are *threshold* alike.

    Bitmaps rule out most pairs, and only those that can be alike are compared by their sets.
    """
    if pairs.isEmpty():
        return pairs
    # sets of a similarity t differ in at most (1 - t) / (1 + t) of both sizes together
    most = (1 - threshold) / (1 + threshold)

    def may(r) -> bool:
        apart = (int.from_bytes(r["x"].to_pybytes(), "big") ^ int.from_bytes(r["y"].to_pybytes(), "big")).bit_count()
        return apart <= (r["n_x"] + r["n_y"]) * most + EPS

    def alike(r) -> bool:
        x, y = np.frombuffer(r["x"], np.int64), np.frombuffer(r["y"], np.int64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= (len(x) + len(y) - both) * threshold - EPS

    def joined(table: DataFrame, names: list[str]) -> DataFrame:
        one = table.select(F.col("fp").alias("a"), *[F.col(n).alias(x) for n, x in zip(names, ("x", "n_x"), strict=False)])
        two = table.select(F.col("fp").alias("b"), *[F.col(n).alias(y) for n, y in zip(names, ("y", "n_y"), strict=False)])
        return one, two

    one, two = joined(scratch.write(parities_of(of_pairs(pairs, texts, keys, scratch), size).distinct()), ["bits", "n"])
    near = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * threshold - EPS
    pairs = scratch.write(within(pairs.join(one, "a").join(two, "b").filter(near), may).distinct())
    if pairs.isEmpty():
        return pairs
    one, two = joined(scratch.write(sets_of(of_pairs(pairs, texts, keys, scratch), size).distinct()), ["tokens"])
    return scratch.write(within(pairs.join(one, "a").join(two, "b"), alike).distinct())


def similar_links(texts: DataFrame, keys: DataFrame, size: int, threshold: float, given: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) with a > b: links that with the *given* ones join all texts that are *threshold* alike, and no others.

    *texts* has text_key and text, *keys* text_key with its fp.
    """
    common = common_shingles(texts, size, texts.count())
    split = bool(len(common[1]) and common[1].max() > PART_MEMBERS)
    shared = scratch.write(shared_buckets(entries(texts, size, threshold, common), split))
    star = stars(shared, split, threshold)
    first = scratch.write(star.groupBy("a", "b").agg(F.bool_or("may").alias("may")))
    links = verified(first.filter("may").select("a", "b"), texts, keys, size, threshold, scratch)
    labels = scratch.write(simhash.components(given.select("a", "b").unionByName(links).distinct()))
    root = lambda fp, name: labels.select(F.col("node").alias(fp), F.col("root").alias(name))
    rooted = first.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left")
    apart = scratch.write(rooted.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "may"))
    if apart.isEmpty():
        return links
    open_ = star.join(apart.select("a", "b"), ["a", "b"], "left_semi").select("token").distinct()
    members = shared.select("token", "fp", "n", "p").join(open_, "token", "left_semi").join(root("fp", "r"), "fp", "left")
    members = scratch.write(members.select("token", "fp", "n", "p", F.coalesce("r", "fp").alias("r")))
    # classes of a bucket that allow a link, before any pair of members
    one = members.select("token", "n", "p").distinct()
    two = one.select("token", F.col("n").alias("m"), F.col("p").alias("q"))
    classes = scratch.write(one.join(two, "token").filter(allowed("n", "p", "m", "q", threshold)))
    other = members.select("token", F.col("fp").alias("fq"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("r").alias("rq"))
    met = members.join(classes, ["token", "n", "p"]).join(other, ["token", "m", "q"]).filter("r < rq")
    rest = met.select(F.greatest("fp", "fq").alias("a"), F.least("fp", "fq").alias("b")).distinct()
    rest = scratch.write(rest.join(apart.filter("may").select("a", "b"), ["a", "b"], "left_anti"))
    return links.unionByName(verified(rest, texts, keys, size, threshold, scratch))
