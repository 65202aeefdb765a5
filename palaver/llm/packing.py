"""Packing of tokenised documents into windows by order-preserving dynamic programming.

The documents of a partition form one stream of tokens, each document closed by an end token.  Windows are runs of at most
``window`` tokens of that stream, in order, so every token lies in exactly one of them.  A window may be cut after a document
(free), after a sentence (``SENTENCE_CUT``) or, where sentences are long, at every ``HARD_EVERY``-th token (``HARD_CUT``); a
window costs its padding, the penalty of its cut and ``WINDOW_COST``, which keeps the number of windows down.  Padding fills
a window up to ``window``, but one whose length is a power of two needs none.  With f(j) the least cost of all windows before
a cut j,

    f(j) = penalty(j) + WINDOW_COST + min( min over cuts i in [j - window, j) of f(i) + i  + window - j,
                                           min over cuts i with j - i a power of two of f(i) )

The first minimum is that of a sliding range and comes from a monotone queue in constant time a cut; cuts a power of two
apart are found in one vectorised search.  As soon as the best paths to all cuts of the last ``window`` tokens share a cut,
nothing later can change what lies before it: those windows are handed on and forgotten, so the result is the optimum of the
partition while a task holds the tokens of a few windows and of one batch.

Scale: one pass over the partitions as they are read, no shuffle.  A partition pays once for its last window.  A lost
executor's partitions are read and cut again to the same windows, as long as their rows come in the same order: hand on a
table, not the output of a shuffle.  ``sequence_id`` is the partition's number in the upper bits and the window's in the lower.

Tokens are those of the given tokenizer file.  Its vocabulary is handed to tiktoken, which merges byte pairs by rank with the
same result, a whole text in one call.

Edge cases: a null or empty text is its end token alone; a very long text runs through as many windows as it needs; repeated rows and ids are documents of their own; null ids stay null; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW, END_TOKEN = 2048, 1
SENTENCE_CUT, HARD_CUT, HARD_EVERY, WINDOW_COST = 4.0, 32.0, 64, 8.0
#: Tokens after which the windows that are certain are handed on.
HAND_ON = 1 << 18
OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: The splitting rule and the only special token of the tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SENTENCE_ENDS = tuple(s.encode() for s in (".", "!", "?", "…", "。", "！", "？"))


class Encoder:
    """Token ids of a byte-level BPE tokenizer file, and the tokens after and before which a sentence may end."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        # byte-level files write a byte as a printable character: the bytes that are printable as themselves, the others from 256 on
        shown = [b for b in range(256) if chr(b) in set(pre_tokenizers.ByteLevel.alphabet())]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.tokens = {bytes(byte_of[c] for c in t): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.core = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=self.tokens, special_tokens=special)
        size = max([*self.tokens.values(), *special.values(), END_TOKEN]) + 1
        self.closes, self.opens, self.breaks = (np.zeros(size, bool) for _ in range(3))
        for t, i in self.tokens.items():
            self.closes[i], self.opens[i], self.breaks[i] = t.rstrip(b"\"')]}").endswith(SENTENCE_ENDS), t[:1].isspace(), b"\n" in t

    def ids(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """How many tokens stand before each place at which a sentence has ended."""
        ends = self.breaks[ids]
        ends[:-1] |= self.closes[ids[:-1]] & self.opens[ids[1:]]
        return np.flatnonzero(ends) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts_of(sentences: np.ndarray, documents: np.ndarray, every: int = HARD_EVERY) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) of the cuts in a run of documents whose sentences and which themselves end at these places."""
    marks = np.union1d(sentences, documents).astype(np.int64)
    gaps = np.diff(marks, prepend=0)
    wide = np.flatnonzero(gaps > every)
    hard = [np.arange(marks[w] - gaps[w] + every, marks[w], every) for w in wide]
    places = np.concatenate((marks, *hard))
    penalties = np.concatenate((np.where(np.isin(marks, documents), 0.0, SENTENCE_CUT), np.full(len(places) - len(marks), HARD_CUT)))
    order = np.argsort(places, kind="stable")
    return places[order], penalties[order]


class Packer:
    """The programme over a stream of cuts; places count tokens from the start of the stream."""

    def __init__(self, window: int = WINDOW):
        self.window, self.powers = window, 2 ** np.arange(int(window).bit_length())
        self.places, self.costs, self.before = [0], [0.0], [-1]  # of every cut that is not handed on
        self.queue: deque[int] = deque([0])  # cuts with rising cost + place

    def extend(self, places: np.ndarray, penalties: np.ndarray) -> None:
        """Further cuts in rising order, none further than a window from the one before."""
        at, cost, before, queue, window = self.places, self.costs, self.before, self.queue, self.window
        known = np.asarray(at[-(window + 1) :], np.int64)  # enough, as places are whole numbers
        first = len(at) - len(known)
        every = np.concatenate((known, places))
        wanted = places[:, None] - self.powers[None, :]
        found = np.searchsorted(every, wanted)
        hit = every[np.minimum(found, len(every) - 1)] == wanted
        rows, _ = np.nonzero(hit)
        sources = (found[hit] + first).tolist()
        upto = np.searchsorted(rows, np.arange(len(places)), side="right").tolist()
        k = 0
        for place, penalty, stop in zip(places.tolist(), penalties.tolist(), upto, strict=True):
            low = place - window
            while at[queue[0]] < low:
                queue.popleft()
            source = queue[0]
            best = cost[source] + at[source] + window - place
            while k < stop:  # a power of two before
                i = sources[k]
                if cost[i] < best:
                    best, source = cost[i], i
                k += 1
            best += penalty + WINDOW_COST
            value = best + place
            while queue and cost[queue[-1]] + at[queue[-1]] >= value:
                queue.pop()
            queue.append(len(at))
            at.append(place)
            cost.append(best)
            before.append(source)

    def certain(self, final: bool = False) -> list[int]:
        """The cuts that are decided, from the last one handed on; they are forgotten but for the last."""
        at, before = self.places, self.before
        end = len(at) - 1
        if not final:
            low = at[-1] - self.window
            heap = []
            while end >= 0 and at[end] >= low:
                heap.append(-end)
                end -= 1
            heapq.heapify(heap)
            alive = set(heap)
            while len(heap) > 1:
                i = -heapq.heappop(heap)
                alive.discard(-i)
                parent = -before[i]
                if parent not in alive:
                    alive.add(parent)
                    heapq.heappush(heap, parent)
            end = -heap[0]
        path = []
        i = end
        while i >= 0:
            path.append(at[i])
            i = before[i]
        base = self.costs[end]  # costs count from here on, so they stay exact
        self.places, self.costs = at[end:], [c - base for c in self.costs[end:]]
        self.before = [-1, *[b - end for b in before[end + 1 :]]]
        self.queue = deque(q - end for q in self.queue if q >= end)
        return path[::-1]


class Stream:
    """The tokens and documents of a partition whose windows are not handed on, and the pieces of those that are."""

    def __init__(self, coder: Encoder, number: int, window: int):
        self.coder, self.packer, self.number, self.count = coder, Packer(window), number, 0
        self.start, self.size = 0, 0  # place of the first token held, tokens held
        self.held: list[np.ndarray] = []
        self.docs: deque[tuple[object, int, int]] = deque()  # id, first token, tokens
        self.fresh: list[np.ndarray] = []  # documents whose cuts the programme has not seen

    def add(self, doc_id: object, text: str) -> int:
        ids = np.append(self.coder.ids(text), np.uint32(END_TOKEN))
        self.docs.append((doc_id, self.start + self.size, len(ids)))
        self.held.append(ids)
        self.fresh.append(ids)
        self.size += len(ids)
        return len(ids)

    def advance(self) -> None:
        if self.fresh:
            ids = np.concatenate(self.fresh)
            places, penalties = cuts_of(self.coder.sentence_ends(ids), np.cumsum([len(d) for d in self.fresh]))
            self.packer.extend(places + (self.start + self.size - len(ids)), penalties)
            self.fresh = []

    def pieces(self, final: bool = False) -> pa.RecordBatch | None:
        self.advance()
        cuts = self.packer.certain(final)
        if len(cuts) < 2:
            return None
        ids = np.concatenate(self.held)
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = a
            while at < b:
                doc_id, first, n = self.docs[0]
                stop = min(b, first + n)
                rows.append((doc_id, at - first, stop - at, ids[at - self.start : stop - self.start].tobytes(), n, self.number + self.count, at - a, b - a))
                if stop == first + n:
                    self.docs.popleft()
                at = stop
            self.count += 1
        rest = ids[cuts[-1] - self.start :].copy()
        self.start, self.held, self.size = cuts[-1], [rest], len(rest)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in OUT.split(", ")])


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", hand_on: int = HAND_ON) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, sequence_tokens.

    *path* is the tokenizer file, readable where tasks run.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, fresh = Stream(encoder(path), TaskContext.get().partitionId() << 33, window), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                fresh += stream.add(doc_id.as_py(), text.as_py() or "")
                if fresh >= hand_on:
                    fresh = 0
                    if (out := stream.pieces()) is not None:
                        yield out
        if (out := stream.pieces(final=True)) is not None:
            yield out

    narrow = docs.selectExpr(f"cast(`{id_col}` AS long) AS doc_id", f"cast(`{text_col}` AS string) AS text")
    return narrow.mapInArrow(pack, OUT)
