"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that any match must contain (lower case): clauses
that must all hold, each with alternatives of trigrams that must all occur.  Of an alternative its rarest
``TRIGRAMS_EACH`` trigrams are looked up; what they let through is verified anyway, and each indexed trigram costs a
search of every text.  The index holds postings (trigram, text key); a query's terms are joined with them on the trigram,
a key's postings are intersected by counting the terms it meets, and texts left are verified with the expression itself.
Rules without a mandatory trigram scan every text.  Only texts with equal content share a key, so copies are one posting.

Edge cases: a null text counts as empty and has no spans; a null or repeated ``doc_id`` is a row of its own;
overlapping kinds are all reported, sorted by start and then kind; a very long text is searched whole, in one task; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import materialize, text_or_empty

sre = re._parser  # the standard library's own pattern parser; were it moved, this fails aloud


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Regular expression that group *group* of a match must satisfy to count, if any.
    keep: str | None = None
    group: int = 0
    base: bool = False


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"^.{12,}$", 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{18,}$", 0, True),
    Rule("hex", r"[0-9a-f]{16,}", None, 0, True),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + EXTRA_RULES

#: Candidate keys up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Alternatives that a literal run may expand to before it is cut.
MAX_ALTERNATIVES = 64
#: Trigrams of an alternative that are indexed, the rarest first: letters by falling frequency in English (fixed values).
TRIGRAMS_EACH = 2
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


# -- Boolean trigram queries ----------------------------------------------------------------------
# A query is a list of clauses that must all hold; a clause is a list of alternatives of which one must
# hold; an alternative is a set of trigrams that must all occur.


def _literals(item) -> list[str] | None:
    """All strings that a parsed item can match, or None where they are not few."""
    op, arg = item
    name = str(op)
    if name == "LITERAL":
        return [chr(arg)]
    if name == "IN":
        if any(str(o) not in ("LITERAL", "RANGE") for o, _ in arg):
            return None
        chars = [c for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
        return [chr(c) for c in chars] if len(chars) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_literals(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_literals(p) for p in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != sre.MAXREPEAT and int(arg[1]) <= 2:
        one = _sequence_literals(arg[2])
        if one is None:
            return None
        return ["".join(x) for n in range(int(arg[0]), int(arg[1]) + 1) for x in itertools.product(one, repeat=n)]
    return None


def _sequence_literals(items) -> list[str] | None:
    found = [""]
    for item in items:
        part = _literals(item)
        if part is None or len(found) * len(part) > MAX_ALTERNATIVES:
            return None
        found = [a + b for a in found for b in part]
    return found


def _clause(strings: list[str]) -> list[frozenset[str]] | None:
    strings = sorted({s.lower() for s in strings})
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)  # a subset implies the rest


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The clauses that any match of *pattern* satisfies; empty if none is mandatory."""
    clauses, run = [], [""]

    def flush():
        nonlocal run
        if c := _clause(run):
            clauses.append(c)
        run = [""]

    for item in sre.parse(pattern):
        op, arg = item
        part = _literals(item)
        if part is None and str(op) in ("MAX_REPEAT", "MIN_REPEAT") and int(arg[0]) >= 1:
            part, cut = _sequence_literals(arg[2]), True  # occurs once at least; what follows is open
        else:
            cut = part is None
        if part is not None and len(run) * len(part) > MAX_ALTERNATIVES:
            flush()
        if part is None or len(part) > MAX_ALTERNATIVES:
            flush()
            continue
        run = [a + b for a in run for b in part]
        if cut:
            flush()
    flush()
    return clauses


# -- index ----------------------------------------------------------------------------------------


def text_key(col: Column) -> Column:
    """Equal texts have equal keys; an accidental equality only adds a candidate."""
    return F.xxhash64(col)


def rarity(trigram: str) -> int:
    """Larger for rarer letters; other signs count as rarest."""
    return sum(LETTERS.index(c) if c in LETTERS else len(LETTERS) for c in trigram)


def query_terms(queries: dict[str, list[list[frozenset[str]]]], each: int = TRIGRAMS_EACH) -> list[tuple]:
    """(trigram, kind, clause, alternative, trigrams of that alternative) of what is looked up."""
    out = []
    for kind, query in queries.items():
        for c, clause in enumerate(query):
            for a, held in enumerate(clause):
                chosen = sorted(held, key=lambda t: (-rarity(t), t))[:each]
                out += [(t, kind, c, a, len(chosen)) for t in chosen]
    return out


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index for *trigrams*: (trigram, key), once for each text of a task."""
    low = docs.select(F.lower(text_or_empty(text_col)).alias("low"), text_key(text_or_empty(text_col)).alias("key"))
    held = F.filter(
        F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull()
    )
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]], each: int = TRIGRAMS_EACH) -> DataFrame:
    """(key, kinds): texts whose postings satisfy the query of a rule.

    The terms (some dozens) are broadcast and joined on the trigram; an alternative is met by a key that has all its
    trigrams, a clause by any alternative, a rule by all its clauses.
    """
    names = ("trigram", "kind", "clause", "alternative", "need")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, term, strict=True)]) for term in query_terms(queries, each)])
    terms = index.sparkSession.range(1).select(F.inline(rows))
    met = index.join(F.broadcast(terms), "trigram")
    alternatives = met.groupBy("key", "kind", "clause", "alternative").agg(F.countDistinct("trigram").alias("n"), F.first("need").alias("need")).filter("n = need")
    clauses = alternatives.groupBy("key", "kind").agg(F.countDistinct("clause").alias("n"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for k, q in queries.items() for x in (k, len(q))]), F.col("kind"))
    return clauses.filter(F.col("n") == wanted).groupBy("key").agg(F.collect_set("kind").alias("kinds"))  # at most the rules


# -- verification ---------------------------------------------------------------------------------


def match_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in code points, end exclusive.

    The pieces between matches and the matches alternate, so running lengths give the positions.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern, -1)
    keep = (lambda s: s.rlike(rule.keep)) if rule.keep else (lambda s: F.lit(True))
    steps = F.zip_with(
        F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"))),
        tested,
        lambda x, t: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), keep(t).alias("ok")),
    )
    none = "array<struct<start:int,end:int>>"
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(
                x["ok"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


def scan_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text_col: str = "text",
    id_col: str = "doc_id",
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per document: doc_id and found, an array of (kind, pos, start, end) by start, then kind."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    body = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    body = body.withColumn("key", text_key(F.col("text")))
    if indexed:
        grams = sorted({t[0] for t in query_terms(indexed)})
        hits = materialize(candidates(postings(docs, grams, text_col), indexed))
        hits = F.broadcast(hits) if hits.count() <= broadcast_keys else hits
        body = body.join(hits, "key", "left")
    none = "array<struct<kind:string,pos:int,start:int,end:int>>"
    parts = []
    for pos, rule in enumerate(rules):
        wanted = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.lit(True)
        kind, at = F.lit(rule.kind).alias("kind"), F.lit(pos).alias("pos")
        tagged = F.transform(match_spans(F.col("text"), rule), lambda s: F.struct(kind, at, s["start"].alias("start"), s["end"].alias("end")))  # noqa: B023
        # the cheap test first: most texts have no match, and then nothing is split
        parts.append(F.when(wanted & F.col("text").rlike(rule.pattern), tagged).otherwise(F.array().cast(none)))
    by_start = F.array_sort(
        F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["pos"].alias("pos"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return body.select("doc_id", by_start.alias("found"))


def span_list(found: Column, kinds: list[str] | None = None) -> Column:
    """'kind:start:end' joined by commas."""
    chosen = F.filter(found, lambda s: s["kind"].isin(kinds)) if kinds else found
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret that a scan reports replaced, overlapping ones by one mask; no index needed."""
    text, pair = F.col(text_col), "array<struct<start:int,end:int>>"
    spans = F.array_sort(F.concat(*[F.when(text.rlike(r.pattern), match_spans(text, r)).otherwise(F.array().cast(pair)) for r in rules]))
    # from the last start to the first, so that what stands before keeps its place
    hidden = F.aggregate(
        F.reverse(spans_merged(spans)), text, lambda t, s: F.concat(F.left(t, s["start"]), F.lit(mask), F.substr(t, s["end"] + 1, F.length(t)))
    )
    return docs.withColumn(text_col, F.when(text.isNotNull(), hidden))


def spans_merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones as one."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))
        return F.when(last.isNotNull() & (s["start"] < last["end"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, none, add)
