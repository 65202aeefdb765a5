"""Spelling variants: words one edit apart, found by range scans of a forward and a reversed sorted dictionary.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  Such an edit leaves a half of
the word intact, so near words stand in one block of words that begin alike (a range of the dictionary sorted forwards) or
in one of words that end alike (a range of the dictionary sorted by reversed words).  To be exact, let ``m`` be the length of
the shorter word and p the length of the two words' common beginning; a block (edit, m, lo, hi, key) holds the pairs
with lo <= p < hi, and all of its words share the first lo characters and the last m - hi (of an insertion m - hi + 1), which
are its key.  The two root blocks of a word split the range of p in the middle: lo > 0 and no common end, or lo = 0 and a
common end.  A block of more than ``BLOCK`` words is subdivided by halving its range of p, and its words get longer keys, until
no block is too large.  A range of one place leaves one free character and is bounded by the alphabet, so this always ends.
Ranges of p are disjoint, so a pair is found once.

Blocks are dealt to tasks by range of their keys and sorted, read in order by one scan that holds a block at a time, and
every pair of a block is verified in the task; only the words' counts of near words and their best near word leave it, never
pairs.  Forms are chains of growing counts, at least doubling, and are followed by pointer jumping in log(log n) rounds.

Scale: a text is read once; words are counted with map-side combining per task, so frequent words move once a task.  The
dictionary has a row a word and six for its root blocks.  All loops write their state to the shared folder.

Edge cases: a null text has no words; a null id counts as an empty one in the check sum; repeated rows count twice; ties of a
form go to the smallest word in code-point order; very long texts and words are handled whole; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch, materialize

#: Runs of letters in UTF-8 once A-Z are lower-cased, in ASCII and with the letters from U+00C0 to U+00FF.
ASCII_RUN, RUN = re.compile(rb"[a-z]+"), re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])+")
LEAST_LENGTH, LEAST_COUNT, SLIP_EVERY, FORM_FACTOR = 5, 3, 97, 2
#: Words of a block that are compared with each other; one with a range of one place has as many as there are letters, 90, at most.
BLOCK = 64
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
WHERE = ["edit", "m", "lo", "hi", "key"]
FOUND = "word string, n_near long, best_n long, best string"


def slipped(word: bytes, h: int) -> bytes:
    """The run without the letter that its check sum names."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def words_of(doc_id: object, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, count) of a document, words of LEAST_LENGTH letters or more."""
    data = text.encode().lower()  # of bytes, A-Z alone
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter((ASCII_RUN if data.isascii() else RUN).findall(data)).items():
        h = zlib.crc32(word, salt)
        if h % SLIP_EVERY == 0:
            word = slipped(word, h)
        if len(word) >= LEAST_LENGTH and (word.isascii() or len(word.decode()) >= LEAST_LENGTH):
            yield word, n


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in words_of(doc_id.as_py(), text.as_py() or ""):
                    held[word] += n
                if len(held) > COUNTED:
                    yield out()
                    held.clear()
        yield out()

    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    counted = narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def block(edit: str, m: Column, lo: Column, hi: Column, word: Column) -> Column:
    """A block of a word: pairs by one *edit* whose common beginning is in [lo, hi), the shorter word being m long."""
    tail = m - hi + (1 if edit == "insert" else 0)
    key = F.concat(F.substr(word, F.lit(1), lo), F.lit(" "), F.substr(F.reverse(word), F.lit(1), tail))
    return F.struct(F.lit(edit).alias("edit"), m.alias("m"), lo.alias("lo"), hi.alias("hi"), key.alias("key"))


def root_blocks(word: Column) -> Column:
    """The blocks of a word as one of two of its length, as the shorter and as the longer one of an insertion."""
    zero, out = F.lit(0), []
    for edit, m in (("replace", F.length(word)), ("insert", F.length(word)), ("insert", F.length(word) - 1)):
        top, middle = (m if edit == "replace" else m + 1), F.floor(m / 2).cast("int")
        out += [block(edit, m, middle, top, word), block(edit, m, zero, middle, word)]
    return F.array(*out)


def halves(word: Column) -> Column:
    """The two blocks of a word that a block of it (columns edit, m, lo, hi) is subdivided into."""
    m, lo, hi = F.col("m"), F.col("lo"), F.col("hi")
    middle = F.floor((lo + hi) / 2).cast("int")
    both = lambda edit: F.array(block(edit, m, middle, hi, word), block(edit, m, lo, middle, word))
    return F.when(F.col("edit") == "replace", both("replace")).otherwise(both("insert"))


def blocks(words: DataFrame, scratch: Scratch, largest: int = BLOCK) -> DataFrame:
    """(edit, m, lo, hi, key, word, n): each word in its blocks, none larger than *largest* unless its range is one place."""
    rows = words.select("word", "n", F.explode(root_blocks(F.col("word"))).alias("b")).select("b.*", "word", "n")
    done = []
    while True:
        rows = scratch.write(rows)
        sizes = rows.filter("hi - lo > 1").groupBy(*WHERE).agg(F.count(F.lit(1)).alias("size"))
        large = scratch.write(sizes.filter(F.col("size") > largest).select(*WHERE))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, WHERE, "left_anti"))
        rows = rows.join(large, WHERE, "left_semi").select("word", "n", F.explode(halves(F.col("word"))).alias("b")).select("b.*", "word", "n")
    return reduce(DataFrame.unionByName, done)


def common_beginning(a: str, b: str, lo: int) -> int:
    """How many first characters two different words share, at least *lo*."""
    end = min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    return lo


def pairs(edit: str, m: int, lo: int, hi: int, held: list[tuple[str, int]]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """The near pairs of a block: a replaced character, or one more in the longer word, after a common beginning of lo to hi - 1."""
    if edit == "replace":
        for k, one in enumerate(held):
            a = one[0]
            for other in held[k + 1 :]:
                b = other[0]
                p = common_beginning(a, b, lo)
                if p < hi and a[p + 1 :] == b[p + 1 :]:
                    yield one, other
    else:
        longer = [w for w in held if len(w[0]) > m]
        for one in held:
            a = one[0]
            if len(a) == m:
                for other in longer:
                    b = other[0]
                    p = common_beginning(a, b, lo)
                    if p < hi and a[p:] == b[p + 1 :]:
                        yield one, other


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of blocks to what each word gains in them: near words, and the best of these with its count."""
    found: dict[str, list] = {}
    at, held = None, []

    def out() -> pa.RecordBatch:
        columns = zip(*[(w, *r) for w, r in found.items()], strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    def note(word: str, other: str, n: int) -> None:
        r = found.setdefault(word, [0, 0, ""])
        r[0] += 1
        if n > r[1] or (n == r[1] and other < r[2]):
            r[1], r[2] = n, other

    def close() -> None:
        if len(held) > 1:
            for (a, n), (b, k) in pairs(*at[:4], held):
                note(a, b, k)
                note(b, a, n)

    for batch in batches:
        for *where, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if where != at:
                close()
                at, held = where, []
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
            held.append((word, n))
    close()
    yield out()


def near_words(words: DataFrame, scratch: Scratch, largest: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words."""
    dealt = blocks(words, scratch, largest).repartitionByRange(*WHERE).sortWithinPartitions(*WHERE, "word")
    gained = dealt.select(*WHERE, "word", "n").mapInArrow(scan, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return gained.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form (columns word, form): pointers that have not reached a word without form jump over their target's pointer."""
    inner = links.select(F.col("word").alias("form"), F.lit(True).alias("inner"))
    at = scratch.write(links.join(inner, "form", "left").select("word", "form", F.coalesce("inner", F.lit(False)).alias("open")))
    done = []
    while True:
        done.append(at.filter(~F.col("open")).select("word", F.col("form").alias("root")))
        still = at.filter("open")
        if still.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # what a closed pointer has reached stays a target for the others
        targets = reduce(DataFrame.unionByName, [d.select("word", F.col("root").alias("form"), F.lit(False).alias("open")) for d in done], still)
        there = targets.select(F.col("word").alias("form"), F.col("form").alias("next"), F.col("open").alias("goes_on"))
        at = scratch.write(still.drop("open").join(there, "form").select("word", F.col("next").alias("form"), F.col("goes_on").alias("open")))


def group_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", largest: int = BLOCK) -> DataFrame:
    """One row a word: word, n, n_near, form, form_n, root."""
    scratch = Scratch(docs.sparkSession)
    try:
        words = scratch.write(count_words(docs, text_col, id_col))
        known = scratch.write(words.join(near_words(words, scratch, largest), "word", "left"))
        has = F.col("best_n") >= FORM_FACTOR * F.col("n")
        formed = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
        ends = roots(formed.filter("form IS NOT NULL").select("word", "form"), scratch)
        return materialize(formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")))
    finally:
        scratch.remove()
