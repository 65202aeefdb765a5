"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of toxic and one of ordinary text.  A window, one lower-cased
word between line breaks or its head, is compressed with either; the bytes that the toxic dictionary saves over the
ordinary one are its evidence.  A document's evidence is that of its strongest windows, and a calibrated
threshold maps it to a score.

This departs from the plain method in two ways, as that gives no right results (README, with figures): the dictionaries'
content is chosen by contrast in place of zstandard's own trainer, and a window is a word in place of running text.

Training is contrastive, since most text of a toxic document is ordinary: the toxic dictionary takes those
parts of toxic windows whose character sequences' document frequencies tell the classes apart; the
ordinary one the most frequent windows of ordinary documents that hold none of them.  Dictionaries are trained on one
half of the training rows and calibrated on the other, then trained again on all of them.  Copies and near copies among
the training rows (equal least word hashes) count once.

The model is fitted on a bounded sample: at most ``TRAIN_TOXIC`` and ``TRAIN_ORDINARY`` labelled documents of any length,
chosen by a hash of their id, of which the driver keeps the distinct words; a dictionary holds at most ``TOXIC_BYTES`` or
``ORDINARY_BYTES``, the strongest or most frequent content first.  Scoring reads every whole text.

Edge cases: null and wordless texts score the lowest value, above 0; without labels of both classes every
document gets that score; repeated label rows count once, and an id with differing labels is not used;
null ids are scored and never used for training; a very long text is scored by all of its words; an empty table gives no rows; further columns are
ignored by :func:`score_documents` and pass through :func:`drop_toxic`.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import fresh

TRAIN_TOXIC = 1500
TRAIN_ORDINARY = 3000
THRESHOLD = 0.7
ORDINARY_BYTES = 100_000
TOXIC_BYTES = 65_536
#: Windows carry a fixed text on either side: zstandard stores shorter inputs raw and starts no match in
#: the last 8 bytes.
PREAMBLE, PADDING = b"<window of text>", b"0123456789ABCDEF"
#: A match takes this many bytes at least, so that a chance syllable is none.
MIN_MATCH = 6
#: Longer words are compressed a second time up to here.
HEAD_BYTES = 7
GRAM_BYTES = (MIN_MATCH, MIN_MATCH + 1, MIN_MATCH + 2)
CACHE_WORDS = 400_000
#: Nats of surprise below which a character sequence is chance.
WEAK = 4.5
#: Share of its words that a byte beside a telling sequence must hold to be drawn in.
SHARED = 0.9
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct words: lower-cased runs of letters (any non-ASCII character counts as one)."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def bounded(word: bytes) -> bytes:
    return b"\n\n\n" + word + b"\n"


def grams(word: bytes) -> set[bytes]:
    """Character sequences of the word and its bounds, from the shortest match to two bytes more."""
    w = bounded(word)
    return {w[i : i + n] for n in GRAM_BYTES for i in range(len(w) - n + 1)}


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    #: evidence in bytes at which a document counts as toxic, and its scale
    cut: float = 2.0
    #: windows that must reach the cut
    needed: int = 1

    def compressors(self):
        def one(raw: bytes):
            how = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, min_match=MIN_MATCH, window_log=20, hash_log=17, chain_log=17, search_log=6,
                target_length=64, write_checksum=0, write_content_size=0, write_dict_id=0,
            )
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress

        return one(self.toxic), one(self.ordinary)


class Scorer:
    """Scores texts; keeps the evidence of words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.seen, self.heads = model, {}, {}
        self.toxic, self.ordinary = model.compressors()

    def saved(self, part: bytes) -> int:
        w = PREAMBLE + part + PADDING
        return len(self.ordinary(w)) - len(self.toxic(w))

    def evidence(self, word: bytes) -> int:
        """Of the word's windows: the whole word, and its head, which no common ending shortens."""
        whole = self.saved(bounded(word))
        if len(word) <= HEAD_BYTES:
            return whole
        head = bounded(word)[: -1 - len(word) + HEAD_BYTES]
        if head not in self.heads:
            if len(self.heads) > CACHE_WORDS:
                self.heads.clear()
            self.heads[head] = self.saved(head)
        return max(whole, self.heads[head])

    def top(self, text: str | None) -> list[int]:
        """The evidence of the strongest windows, falling, whole text."""
        seen, out = self.seen, []
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in words_of(text):
            e = seen.get(w)
            if e is None:
                e = self.evidence(w)
                if len(w) <= 64:
                    seen[w] = e
            out.append(e)
        out.sort(reverse=True)
        return out

    def score(self, text: str | None) -> float:
        return to_score(self.top(text), self.model)


def to_score(top: list[int], model: Model) -> float:
    """Above the threshold when ``needed`` windows reach the cut; further strong windows add a little."""
    if len(top) < model.needed:
        return 0.01
    least = top[model.needed - 1]
    strong = sum(1 for e in top if e >= model.cut)
    level = math.log(THRESHOLD / (1 - THRESHOLD)) + 0.9 * (least - model.cut + 0.5) + 0.15 * math.log1p(strong)
    level = level if least >= model.cut else min(level, math.log(THRESHOLD / (1 - THRESHOLD)) - 0.2)
    return 0.01 + 0.98 / (1 + math.exp(-level))


# -- training -------------------------------------------------------------------------------------


def surprise(a: int, b: int, n_a: int, n_b: int) -> float:
    """How unlikely it is, in nats, that a of n_a and b of n_b documents share one rate; 0 if a is not above."""
    expected = (a + b) * n_a / (n_a + n_b)
    return a * math.log(a / expected) - (a - expected) if a > expected else 0.0


def telling_grams(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> set[bytes]:
    """Character sequences far more frequent in toxic documents than in ordinary ones.

    The most surprising one is taken first, and the words that hold it are explained and count no more;
    so it goes on while a sequence is beyond chance among all of them, and then, for toxic documents
    without any telling sequence, while it is beyond WEAK.
    """
    n_t, n_o = len(toxic), len(ordinary)
    df_t, df_o = Counter(w for d in toxic for w in d), Counter(w for d in ordinary for w in d)
    of_word = {w: grams(w) for w in df_t}
    count: Counter = Counter()
    for w, n in df_t.items():
        for g in of_word[w]:
            count[g] += n
    tried = sum(1 for n in count.values() if n >= 2)
    other: Counter = Counter()
    for w, n in df_o.items():
        for g in of_word.get(w) or grams(w):
            if g in count:
                other[g] += n

    def weight(g: bytes, a: int) -> float:
        return surprise(a, other[g], n_t, n_o) if a * n_o >= 6 * n_t * (other[g] + 0.3) else 0.0

    holding: dict[bytes, list[bytes]] = {g: [] for g, n in count.items() if n >= 2 and weight(g, n) >= WEAK}
    for w, gs in of_word.items():
        for g in gs:
            if g in holding:
                holding[g].append(w)
    chosen: set[bytes] = set()
    explained: set[bytes] = set()

    def take(g: bytes, left: Counter) -> None:
        chosen.add(g)
        for w in holding[g]:
            if w not in explained:
                explained.add(w)
                for h in of_word[w]:
                    left[h] -= df_t[w]

    def best_of(left: Counter, least: float) -> None:
        heap = [(-weight(g, left[g]), g) for g in holding]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= least:
            stale, g = heapq.heappop(heap)
            now = weight(g, left[g])
            if now >= -stale - 1e-9:
                if now >= least:
                    take(g, left)
            else:
                heapq.heappush(heap, (-now, g))

    best_of(count, math.log(max(2, tried)) + 2)
    bare = [d for d in toxic if d.isdisjoint(explained)]
    weak: Counter = Counter()
    for d in bare:
        for w in d:
            for g in of_word[w]:
                weak[g] += 1
    df_t = Counter(w for d in bare for w in d)
    best_of(weak, WEAK)
    return chosen


def telling_segments(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> Counter:
    """Telling sequences with their frequency, each drawn out by the bytes that nearly all its words share."""
    df_t = Counter(w for d in toxic for w in d)
    words = {bounded(w): n for w, n in df_t.items()}
    out: Counter = Counter()
    for g in telling_grams(toxic, ordinary):
        held = {w: n for w, n in words.items() if g in w}
        total, seg = sum(held.values()), g
        grown = True
        while grown and total:
            grown = False
            for side in (-1, 1):
                at: Counter = Counter()
                for w, n in held.items():
                    i = w.find(seg)
                    j = i - 1 if side < 0 else i + len(seg)
                    at[w[j : j + 1] if 0 <= j < len(w) else b""] += n
                byte, n = at.most_common(1)[0]
                if byte and n >= SHARED * total:
                    seg = byte + seg if side < 0 else seg + byte
                    held = {w: n for w, n in held.items() if seg in w}
                    grown = True
        out[seg] = max(out[seg], sum(held.values()))
    return out


def fit_dictionaries(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> Model | None:
    """Dictionary content, the most frequent last, where matches are cheapest; both end with the preamble."""
    if not toxic or not ordinary:
        return None
    telling = telling_segments(toxic, ordinary)
    common = Counter(w for d in ordinary for w in d)
    if not telling:
        return None

    def content(parts: Iterable[bytes], size: int) -> bytes:
        chosen, held = [], 0
        for p in parts:
            held += len(p)
            if held > size:
                break
            chosen.append(p)
        return b"".join(reversed(chosen)) + PREAMBLE

    by_rank = lambda c: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    # a word of ordinary text that holds a telling sequence by chance would hide it
    held = re.compile(b"|".join(re.escape(t) for t in sorted(telling)))
    common = Counter({w: n for w, n in common.items() if not held.search(bounded(w))})
    return Model(
        content((s + b"\0" for s in by_rank(telling)), TOXIC_BYTES), content(map(bounded, by_rank(common)), ORDINARY_BYTES)
    )


def calibrate(model: Model, toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> Model:
    """The cut and the number of windows that catch most toxic documents for the least false alarms (each rate
    of which weighs four times, as toxic documents are few)."""
    scorer = Scorer(model)
    held: dict[bytes, int] = {}

    def tops(docs):
        for d in docs:
            for w in d:
                if w not in held:
                    held[w] = scorer.evidence(w)
            strongest = sorted((held[w] for w in d), reverse=True)[:8]
            yield strongest + [-99] * (8 - len(strongest))

    t, o = list(tops(toxic)), list(tops(ordinary))
    tried = []
    for needed in (1, 2):
        for cut in range(2, 12):
            caught = sum(e[needed - 1] >= cut for e in t) / max(1, len(t))
            wrong = sum(e[needed - 1] >= cut for e in o) / max(1, len(o))
            tried.append((caught - 4 * wrong, needed, cut))
    top = max(tried)[0]
    needed = min(n for g, n, _ in tried if g >= top - 0.01)
    cuts = [c for g, n, c in tried if n == needed and g >= top - 0.004]
    model.cut, model.needed = sum(cuts) / len(cuts), needed
    return model


def without_copies(docs: Iterable[tuple[object, set[bytes], int]]) -> list[tuple[object, set[bytes], int]]:
    """One of each group of copies or near copies: whose two least word hashes agree under any of three seeds."""
    seen: set[tuple] = set()
    out = []
    for doc_id, words, label in docs:
        keys = [(label, s, *sorted(zlib.crc32(w, s) for w in words)[:2]) for s in (1, 2, 3)]
        if not any(k in seen for k in keys):
            out.append((doc_id, words, label))
        seen.update(keys)
    return out


def train(rows: Iterable[tuple[object, str | None, int]]) -> Model | None:
    """From (id, text, label) rows; None without both classes."""
    halves: list[tuple[list, list]] = [([], []), ([], [])]
    ordered = sorted(rows, key=lambda r: (str(r[0]), r[2]))
    for doc_id, words, label in without_copies((i, words_of(t), y) for i, t, y in ordered):
        halves[zlib.crc32(b"half" + str(doc_id).encode()) % 2][int(label == 1)].append(words)
    if not any(h[0] for h in halves) or not any(h[1] for h in halves):
        return None
    (o1, t1), (o2, t2) = halves
    full = fit_dictionaries(t1 + t2, o1 + o2)
    if full is None:
        return None
    cuts = [calibrate(m, t, o) for m, t, o in ((fit_dictionaries(t1, o1), t2, o2), (fit_dictionaries(t2, o2), t1, o1)) if m is not None and t and o]
    if cuts:
        full.needed = min(m.needed for m in cuts)
        full.cut = sum(m.cut for m in cuts) / len(cuts)
    return full


# -- operators ------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, usable) -> list:
    """(id, text, label) of a bounded sample: both labels by hash of the id; a text is its distinct words, sorted.

    The chosen ids, at most TRAIN_TOXIC + TRAIN_ORDINARY, are broadcast; the documents are only filtered.
    """
    votes = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .filter(usable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .filter("toxic = other")
        .select("doc_id", "toxic")
    )
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = votes.filter("toxic = 1").orderBy(*by_hash).limit(TRAIN_TOXIC).unionByName(
        votes.filter("toxic = 0").orderBy(*by_hash).limit(TRAIN_ORDINARY)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    listed = lambda t: b" ".join(sorted(words_of(t))).decode("utf-8", "surrogatepass")
    return [(r["doc_id"], listed(r["text"]), r["toxic"]) for r in found.toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, usable=lambda doc_id: F.lit(True)) -> Model | None:
    return train(training_rows(docs, labels, usable))


def score_documents(
    docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The documents' columns, or those named by *keep*, with a score in (0, 1) after them."""
    keep = docs.columns if keep is None else keep
    name = fresh(score_col, docs)
    if model is None:
        return docs.select(*keep, F.lit(0.01).alias(name))
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    at, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), scores], names=[*keep, name])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, usable=lambda doc_id: F.lit(True)) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    name = fresh("score", docs)
    return score_documents(docs, fit(docs, labels, usable), score_col=name).filter(F.col(name) < threshold).drop(name)
