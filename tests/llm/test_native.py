"""Exact dedup, secret scan, chat formatting, mixing and line dedup on edge cases and against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from palaver.llm import chat_format, exact_dedup, line_dedup, mixing, secret_scan


def plan_has_python(df):
    plan = df._jdf.queryExecution().toString()
    return bool(re.search("Python|Pandas|Arrow", plan))


# -- exact dedup ----------------------------------------------------------------------------------


def test_dedup_edge_cases(spark, documents):
    out = exact_dedup.resolve_duplicates(documents)
    rows = out.collect()
    assert len(rows) == 12 and not plan_has_python(out)
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    for rs in groups.values():
        assert sum(r.kept for r in rs) == 1 and {r.group_size for r in rs} == {len(rs)}
        ids = [r.doc_id for r in rs if r.doc_id is not None]
        assert {r.keep_id for r in rs} == {max(ids) if ids else None}
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r.doc_id for r in groups[empty]) == [3, 4]
    assert exact_dedup.resolve_duplicates(documents.limit(0)).count() == 0
    kept = exact_dedup.drop_duplicates_exact(documents)
    assert kept.columns == documents.columns and kept.count() == len(groups)


def test_dedup_splits_heavy_groups(spark):
    """A group over the support goes the broadcast way, the rest the shuffled way; results agree."""
    rows = [(i, "hot" if i % 3 else f"t{i % 200}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(t for _, t in rows)
    for support in (0.5, 0.01, 1e-4):
        got = exact_dedup.resolve_duplicates(df, support).collect()
        assert Counter(r.group_size for r in got) == Counter(want[t] for _, t in rows)
        assert sorted(r.doc_id for r in got if r.kept) == sorted({t: i for i, t in rows}.values())


# -- secret scan ----------------------------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def plain_spans(text):
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(x for _, _, x in sorted(out))


def test_trigram_queries():
    by = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert by["hex"] == [] and [set(a) for a in by["access"][0]] == [{"aki", "kia"}]
    assert {"sec", "ecr", "cre", "ret"} in [set(a) for a in by["assign"][0]] and len(by["assign"][0]) == 6
    assert len(by["pem"]) == 2


def test_secrets_match_plain_search(spark):
    rng = random.Random(1)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", '"', "'", " ", " = ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeef", "é", "\n", "x", "abcdefghijklm", "eyJ", "-"]
    texts = [None, "", "token = token = abcdefghijklmn", "ÄÖ password:'abcdefghijkl' 0123456789abcdefg"] + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    for limit in (10**6, 0):  # candidates broadcast, and joined by a shuffle
        out = secret_scan.scan_secrets(df, broadcast_keys=limit)
        got = {r.doc_id: r.s for r in out.select("doc_id", secret_scan.span_list(F.col("found"), kinds).alias("s")).collect()}
        assert got == {i: plain_spans(t) for i, t in enumerate(texts)} and not plan_has_python(out)


def test_extra_rules_and_edges(spark, documents):
    text = "ghp_" + "g7" * 18 + " xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [s.kind for s in secret_scan.scan_secrets(df).first().found] == ["github", "slack", "pem"]
    assert secret_scan.scan_secrets(documents).count() == 12 and secret_scan.scan_secrets(documents.limit(0)).count() == 0
    assert secret_scan.redact_secrets(df).first().text == "[SECRET] [SECRET] [SECRET]"
    odd = spark.createDataFrame([(1, "token=short password=0123456789abcdef0123 ok"), (2, None), (3, "é AKIA" + "Z" * 16)], "doc_id long, text string")
    assert [r.text for r in secret_scan.redact_secrets(odd).orderBy("doc_id").collect()] == ["token=short [SECRET] ok", None, "é [SECRET]"]


def test_postings_are_intersected(spark):
    texts = ["my password is here", "pass the word", "PASSWORD: x", "api_key", "api key", "akia AKIA", "-----BEGIN PRIVATE KEY", "-----BEGIN RSA PRIVATE KEY-----", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    queries = {r.kind: q for r in secret_scan.RULES if (q := secret_scan.trigram_query(r.pattern))}
    for each in (1, 2, 99):
        grams = sorted({t[0] for t in secret_scan.query_terms(queries, each)})
        got = {r.key: set(r.kinds) for r in secret_scan.candidates(secret_scan.postings(df, grams), queries, each).collect()}
        keys = {r.doc_id: r.k for r in df.select("doc_id", secret_scan.text_key(F.col("text")).alias("k")).collect()}
        for i, text in enumerate(texts):
            chosen = lambda a: sorted(a, key=lambda t: (-secret_scan.rarity(t), t))[:each]  # noqa: E731, B023
            want = {k for k, q in queries.items() if all(any(all(t in text.lower() for t in chosen(a)) for a in c) for c in q)}
            assert got.get(keys[i], set()) == want


# -- chat formatting ------------------------------------------------------------------------------

CHUNKS = ["<", "[", "\\", "|im_start|>", "<|im_end|>", "/s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "a", "\n", "é", " ", "s>", "n"]


def read_back(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat_format.format_conversations(df)
    got = defaultdict(list)
    cols = [chat_format.parse_formatted(F.col("formatted")).alias("turns"), chat_format.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("t")]
    for r in ex.select("conv_id", "example", "trainable", "formatted", *cols).orderBy("conv_id", "example").collect():
        got[r.conv_id].append(r)
    return ex, got


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "a\\nb\n\\", ""])
            rows.append((conv, turn, role, "".join(rng.choices(CHUNKS, k=rng.randrange(12)))))
    ex, got = read_back(spark, rows)
    assert not plan_has_python(ex)
    for conv in range(60):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        last = got[conv][-1]
        assert [(t.role, t.text) for t in last.turns] == turns
        assert [r.t for r in got[conv] if r.trainable] == [t for r, t in turns if r == "assistant"]
        for r in got[conv]:
            assert [(t.role, t.text) for t in r.turns] == turns[: r.example]


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.sampled_from(CHUNKS), max_size=14).map("".join))
def test_escaping_is_reversible(text):
    """The same patterns as the Spark expressions, in Python."""
    rest = chat_format._REST
    up = re.sub(r"([<\[])(\\*)" + rest, r"\1\\\2\3", text)
    assert re.sub(r"([<\[])\\(\\*)" + rest, r"\1\2\3", up) == text
    assert not any(c in up for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]"))


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", None), (None, 0, "user", "hi"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    _, got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[1][-1].turns] == [("", ""), ("assistant", "")]
    assert [r.trainable for r in got[None]] == [False] and len(got[2]) == 2
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string, parts int")).count() == 0


# -- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The excess handed on by weight until no target is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = share * sum(sizes.values()) - sum(target.values())
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
        if not open_:
            return target


def test_targets_match_plain_version(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 50, 1000, 100_000]) for s in [None, "b", "B", "ä", "z", "aa"][: rng.randrange(1, 7)]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def plain_mix(rows, seed=17):
    """(doc_id, taken) of (doc_id, text, source) rows: whole copies, then a prefix of the Pareto order, words by hand."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    of = Counter()
    for (_, _, s), n in zip(rows, sizes, strict=True):
        of[s] += n
    targets = plain_targets(of)
    taken = [0] * len(rows)
    for s, target in targets.items():
        whole = math.floor(target / of[s] + 1e-12) if of[s] else 0
        mine = []
        for k, (i, t, source) in enumerate(rows):
            if source == s and sizes[k]:
                u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine.append((u / (1 - u) / sizes[k], -1 if i is None else i, sizes[k], k))
                taken[k] = whole * sizes[k]
        rest, run = max(0.0, target - whole * of[s]), 0
        for key, peers in itertools.groupby(sorted(mine), key=lambda m: m[:3]):
            peers = list(peers)
            run += key[2] * len(peers)
            if rest > 0 and run - key[2] / 2 <= rest:
                for m in peers:
                    taken[m[3]] += key[2]
    return [(i, n) for (i, _, _), n in zip(rows, taken, strict=True)]


def test_mix_matches_plain_version(spark, documents):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.choice([1, 3, 10, 39, 200])), rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(3000)]
    rows += [(7, "same row again", "a")] * 5 + [(None, "no id", "b"), (None, None, "b"), (1, "   ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    want = plain_mix(rows)
    for per_bucket in (20_000, 30):
        out = mixing.mix(df, rows_per_bucket=per_bucket)
        got = out.collect()
        assert not plan_has_python(out) and sorted(((r.doc_id, r.taken) for r in got), key=str) == sorted(want, key=str)
        for s in {r.source for r in got}:
            rs = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in rs) - rs[0].target) <= 200 and rs[0].source_size == sum(r.size for r in rs)
        assert all(r.taken <= 2 * r.size for r in got)
        assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in mixing.mix(df.repartition(7), rows_per_bucket=per_bucket).collect())
    longer = lambda rs: sum(r.size for r in rs) / max(1, len(rs))
    hot = [r for r in got if r.source == "hot" and r.size]
    least = min(r.copies for r in hot)
    assert longer([r for r in hot if r.copies > least]) > 1.3 * longer([r for r in hot if r.copies == least])  # odds grow with size
    edge = mixing.mix(documents).collect()
    assert len(edge) == 12 and all(r.taken == 0 for r in edge if r.size == 0) and mixing.mix(documents.limit(0)).count() == 0


def test_mixed_documents_keep_their_columns(spark, documents):
    odd = documents.withColumn("copies", F.lit("c")).withColumn("taken", F.lit("t"))
    out = mixing.mix_documents(odd)
    assert out.columns[:-2] == odd.columns and len(set(out.columns)) == len(out.columns)
    want = sorted((str(r.doc_id), r.taken) for r in mixing.mix(documents).collect() if r.taken)
    assert sorted((str(r[0]), r[-1]) for r in out.collect()) == want and mixing.mix_documents(odd.limit(0)).count() == 0


# -- line dedup -----------------------------------------------------------------------------------


def plain_line_dedup(rows, ratio, least):
    strip = " \t\n\x0b\x0c\r"
    pages, holds = Counter(), Counter()
    for text, host in {(t or "", h) for _, t, h in rows}:  # copies are one page
        pages[host] += 1
        for line in {x.strip(strip) for x in text.split("\n")} - {""}:
            holds[host, line] += 1
    common = {k for k, n in holds.items() if n >= least and n > pages[k[0]] * ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(strip)) not in common) for _, t, h in rows]


def test_line_dedup_matches_plain_version(spark):
    rng = random.Random(2)
    lines = ["menu", " menu ", "footer", "", "one", "two", "three", "é", "a\tb"]
    rows = [(i, rng.choice([None, "", "\n".join(rng.choices(lines, k=rng.randrange(6)))]), rng.choice(["h", "g", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for ratio, least in ((0.2, 3), (0.5, 2), (0.0, 1)):
        for limit in (10**6, 0):  # broadcast, and joined by a shuffle
            out = line_dedup.drop_boilerplate(df, ratio, least, broadcast_lines=limit)
            got = {r.doc_id: r.text for r in out.collect()}
            assert [got[i] for i, _, _ in rows] == plain_line_dedup(rows, ratio, least) and not plan_has_python(out)


def test_line_dedup_edges(spark, documents):
    for limit in (10**6, 0):
        out = line_dedup.drop_boilerplate(documents, 0.1, 2, broadcast_lines=limit)
        assert out.columns[: len(documents.columns)] == documents.columns and out.count() == 12 and len(out.columns) == len(documents.columns) + 1
        assert sorted(r.text for r in out.filter("doc_id IN (8, 9)").collect()) == ["other", "Ünï cödé \u2028 text\nlast"]
        assert line_dedup.drop_boilerplate(documents.limit(0), broadcast_lines=limit).count() == 0


def test_copies_are_one_page(spark):
    rows = [(i, f"menu\nstory {i}", "h") for i in range(10)] + [(100 + i, "copied\nline", "h") for i in range(500)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.2).collect()}
    assert got[3] == "story 3" and all(got[100 + i] == "copied\nline" for i in range(500))
