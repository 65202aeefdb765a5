"""Benchmark decontamination with an FM-index per shard of training text.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.  A benchmark item
contributes every window of ``window`` consecutive words (one shorter window if it has fewer).  Documents are read
in shards; each shard's words become an FM-index: suffix array, Burrows-Wheeler transform with a wavelet
matrix for ranks, and sampled suffix positions.  Every window is searched backwards through the ranks, its
occurrences are located from the samples, and overlapping occurrences merge into spans of words.

Before it is indexed, a shard loses what no window can touch: words that no item has become separators, and
so do stretches whose word pairs do not follow each other in any item or that are shorter than the
shortest window.  That drops no occurrence.

The benchmark is read in blocks of ``BLOCK_BYTES`` of text.  A block's windows are places in its sequence of words, so
that it compiles to about 13 bytes a word and its vocabulary.  One block is broadcast at a time; where the benchmark has
several, what a pass over the documents found is written to the shared folder before the next block is read.

Edge cases: null texts have no words; items without words have no windows; a null item_id is written as an
empty string; repeated items with one id count once; repeated rows are rows of their own; a very long text is indexed whole, in its shard; an empty benchmark
leaves every document clean; an empty table gives no rows; further columns pass through
:func:`remove_contamination` and are ignored by :func:`find_contamination`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import Scratch, fresh

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 20
SAMPLE_EVERY = 8
PAIR_BITS = 22
#: Bytes of words: digits, a-z and all of non-ASCII; A-Z fall to a-z; the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_bytes(text: str | None) -> bytes:
    """The text in UTF-8 with what is not part of a word blanked; offsets stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


# -- benchmark ------------------------------------------------------------------------------------


@dataclass
class Windows:
    """Windows of some items, by length: starts[m] are places in *words*, the items' word numbers (from 1) one after the other."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    starts: dict[int, np.ndarray]
    #: numbers, in *items*, of the items of these windows
    owners: dict[int, np.ndarray]
    items: list[str]
    pairs: np.ndarray
    shortest: int


def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots in the table of word pairs; an accidental equality only keeps more text."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PAIR_BITS)


def compile_windows(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> Windows | None:
    vocabulary: dict[bytes, int] = {}
    parts, names, at = [], [], 0
    starts: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    pairs = np.zeros(1 << PAIR_BITS, bool)
    for item_id, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in word_bytes(text).split()], np.int32)
        if not len(ids):
            continue
        m = min(window, len(ids))
        n = len(ids) - m + 1
        starts.setdefault(m, []).append(np.arange(at, at + n, dtype=np.int32))
        owners.setdefault(m, []).append(np.full(n, len(names), np.int32))
        pairs[pair_slots(ids[:-1], ids[1:])] = True
        parts.append(ids)
        names.append("" if item_id is None else str(item_id))
        at += len(ids)
    if not parts:
        return None
    return Windows(
        vocabulary, np.concatenate(parts), {m: np.concatenate(x) for m, x in starts.items()}, {m: np.concatenate(x) for m, x in owners.items()},
        names, pairs, min(starts),
    )


# -- index ----------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; equal symbols 0 count as different, so it ends at the longest stretch."""
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols + int(zeros.sum()))
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, step = new, step * 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of queries."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels, self.ones, self.zeros = max(1, int(sigma).bit_length()), [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(sequence) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position upto."""
        start = np.zeros(len(symbol), np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - i)) & 1 == 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            upto = np.where(bit, zeros + ones[upto], upto - ones[upto])
        return upto - start


class FMIndex:
    """Over a sequence of word numbers (from 1) in which 0 separates stretches; it ends with a 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the transform: what stands before each suffix
        self.ranks = WaveletMatrix(self.last, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        # the positions kept: every so many, and the starts of stretches, which no walk may pass
        self.kept = (order % every == 0) | (self.last == 0)
        self.slot = np.cumsum(self.kept) - 1
        self.position = order[self.kept]

    def search(self, words: np.ndarray, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, low, high) of the windows words[start : start + m] that occur: backwards, a rank pair for each word."""
        row = np.arange(len(starts))
        last = words[starts + (m - 1)].astype(np.int64)
        low, high = self.first[last], self.first[last + 1]
        for j in range(m - 2, -1, -1):
            alive = low < high
            row, low, high = row[alive], low[alive], high[alive]
            if not len(row):
                break
            symbol = words[starts[row] + j].astype(np.int64)
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
        alive = low < high
        return row[alive], low[alive], high[alive]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back to a kept one."""
        found, open_, steps = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(open_):
            done = self.kept[at]
            found[open_[done]] = self.position[self.slot[at[done]]] + steps
            at, open_ = at[~done], open_[~done]
            symbol = self.last[at]
            at = self.first[symbol] + self.ranks.rank(symbol, at)
            steps += 1
        return found


# -- shards ---------------------------------------------------------------------------------------


def prune(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """What windows can touch: (symbols with 0 after each stretch, positions of the symbols)."""
    if windows.shortest == 1:
        linked = np.zeros(len(ids), bool)
        linked[1:] = (ids[1:] > 0) & (ids[:-1] > 0)
    else:
        linked = np.zeros(len(ids), bool)
        linked[1:] = windows.pairs[pair_slots(ids[:-1], ids[1:])] & (ids[1:] > 0) & (ids[:-1] > 0)
    known = ids > 0
    starts = np.flatnonzero(known & ~linked)
    ends = np.flatnonzero(known & ~np.concatenate([linked[1:], [False]])) + 1
    long = ends - starts >= windows.shortest
    starts, ends = starts[long], ends[long]
    sizes = ends - starts
    # each stretch and one place after it
    offsets = np.cumsum(sizes + 1) - sizes - 1
    total = int((sizes + 1).sum())
    position = np.arange(total) - np.repeat(offsets, sizes + 1) + np.repeat(starts, sizes + 1)
    symbols = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[offsets + sizes] = False
    symbols[inside] = ids[position[inside]]
    return symbols, position


def scan_shard(docs: list[list[bytes]], windows: Windows) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each document, given as words: merged spans (rows of start, end) and the items found, sorted."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int((sizes + 1).sum()), np.int64)
    for at, words in zip(starts, docs, strict=True):
        ids[at : at + len(words)] = np.fromiter(map(windows.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))
    symbols, position = prune(ids, windows)
    spans = [np.zeros((0, 2), np.int64)] * len(docs)
    items: list[list[str]] = [[]] * len(docs)
    if not len(symbols):
        return spans, items
    index = FMIndex(symbols, len(windows.vocabulary))
    change = np.zeros(len(ids) + 1, np.int64)
    found: dict[int, set[str]] = {}
    for m, places in windows.starts.items():
        row, low, high = index.search(windows.words, places, m)
        if not len(row):
            continue
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        word = position[index.locate(at)]
        np.add.at(change, word, 1)
        np.add.at(change, word + m, -1)
        doc = np.searchsorted(starts, word, side="right") - 1
        both = np.unique(np.stack([doc, np.repeat(windows.owners[m][row], counts)]), axis=1)
        for d, item in both.T.tolist():
            found.setdefault(d, set()).add(windows.items[item])
    hit = np.cumsum(change)[:-1] > 0
    for d, ids_found in found.items():
        own = np.concatenate([[0], hit[starts[d] : starts[d] + sizes[d]].view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(own))
        spans[d], items[d] = edges.reshape(-1, 2), sorted(ids_found)
    return spans, items


def scan_texts(texts: list[str | None], windows: Windows, shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(number of words, spans, items) for each text, in order; shards are cut as words come."""
    shard: list[list[bytes]] = []
    held = 0

    def flush():
        for words, spans, items in zip(shard, *scan_shard(shard, windows), strict=True):
            yield len(words), spans, items

    for text in texts:
        words = word_bytes(text).split()
        if shard and held + len(words) > shard_words:
            yield from flush()
            shard, held = [], 0
        shard.append(words)
        held += len(words)
    yield from flush()


def cut_words(text: str, spans: np.ndarray) -> str:
    """The text without its words from start to end of each span, and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.concatenate([[0], (np.frombuffer(word_bytes(text), np.uint8) != 32).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    parts, at = [], 0
    for start, end in spans:
        parts.append(raw[at : edges[start, 0]])
        at = edges[end - 1, 1]
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


# -- operators ------------------------------------------------------------------------------------


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The compiled windows of the benchmark, block after block of bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        compiled = compile_windows(((r[0], r[1]) for r in mine.toLocalIterator()), window)  # at most about block_bytes
        if compiled is not None:
            yield compiled


def in_turn(items: Iterator) -> Iterator[tuple]:
    """(item, whether it is the last)."""
    held = next(items, None)
    while held is not None:
        following = next(items, None)
        yield held, following is None
        held = following


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (words, end exclusive) and items (ids, sorted)."""
    spark = docs.sparkSession
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    none = "array<struct<start:long,end:long>>"
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(none).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_words long, spans {none}, items array<string>"
    names = ["doc_id", "text", "n_words", "spans", "items"]

    def step(held, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                if held is None:
                    found = [(len(word_bytes(t).split()), np.zeros((0, 2), np.int64), []) for t in texts]
                else:
                    found = list(scan_texts(texts, held.value))
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                merged = [(n, merge([[s["start"], s["end"]] for s in old], spans.tolist()), sorted({*ids, *known})) for (n, spans, ids), (old, known) in zip(found, before, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text"),
                        pa.array([x[0] for x in merged], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in merged], spans_type),
                        pa.array([x[2] for x in merged], pa.list_(pa.string())),
                    ],
                    names=names,
                )

        return run

    scratch, passes = None, 0
    for block, last in in_turn(benchmark_blocks(benchmark, window, block_bytes)):
        held = spark.sparkContext.broadcast(block)
        rows, passes = rows.mapInArrow(step(held, last), schema), passes + 1
        if not last:
            scratch = scratch or Scratch(spark)
            rows = scratch.write(rows)
            held.unpersist()
    if not passes:
        rows = rows.mapInArrow(step(None, True), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def merge(a: list, b: list) -> list:
    """Two lists of disjoint spans as one."""
    if not a or not b:
        return a or b
    out: list = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the words that windows hit; what is left is scanned again until nothing is hit.

    A document of which no word is left is dropped; others keep all their columns, and ``n_hit_words`` is added.  With
    several blocks, rounds over all of them are repeated until one changes nothing.
    """
    spark = docs.sparkSession
    hits = fresh("n_hit_words", docs)
    names = [*docs.columns, hits]
    at = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(hits, T.LongType())])

    def clean(texts: list[str | None], windows: Windows) -> list[tuple[str | None, int]]:
        out = [(t, 0) for t in texts]
        todo = list(range(len(texts)))
        while todo:
            changed = []
            for i, (_, spans, _) in zip(todo, list(scan_texts([out[i][0] for i in todo], windows)), strict=True):
                if len(spans):
                    out[i] = (cut_words(out[i][0], spans), out[i][1] + int((spans[:, 1] - spans[:, 0]).sum()))
                    changed.append(i)
            todo = changed
        return out

    def step(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cleaned = clean(batch.column(at).to_pylist(), held.value)
                total = [n + before for (_, n), before in zip(cleaned, batch.column(hits).to_pylist(), strict=True)]
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns[at] = pa.array([t for t, _ in cleaned], pa.string())
                out = pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64())], names=names)
                keep = [not n or bool(word_bytes(t).split()) for (t, _), n in zip(cleaned, total, strict=True)]
                yield out.filter(pa.array(keep, pa.bool_()))

        return run

    rows, scratch, before = docs.withColumn(hits, F.lit(0).cast("long")), None, 0
    while True:
        for block, last in in_turn(benchmark_blocks(benchmark, window, block_bytes)):
            held = spark.sparkContext.broadcast(block)
            rows = rows.mapInArrow(step(held), schema)
            if scratch is None and last:
                return rows  # a single block: each document was scanned until nothing was hit
            scratch = scratch or Scratch(spark)
            rows = scratch.write(rows)
            held.unpersist()
        if scratch is None:
            return rows
        now = rows.agg(F.sum(hits), F.count(F.lit(1))).first()
        if now == before:
            return rows
        before = now
