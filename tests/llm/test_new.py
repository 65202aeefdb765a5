"""Filter audit, packing and spelling variants on edge cases and against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palaver.llm import filter_audit, packing, spelling
from palaver.llm import queries as llm_queries
from palaver.llm.common import Scratch
from tests.llm.conftest import FOLDER

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# -- filter audit ---------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """Every order is run filter by filter over the documents left."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    docs = defaultdict(list)
    for d, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > first[text],
        }
        docs[lang or ""].append((fails, d in good, d in toxic))
    out = []
    for part, members in docs.items():
        shapley = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone, stay = [m for m in left if m[0][f]], [m for m in left if not m[0][f]]
                all_failing = sum(m[0][f] for m in members)
                alone = sum(m[0][f] and sum(m[0].values()) == 1 for m in members)
                found.append((part, "".join(order), step, len(stay), len(gone), all_failing - len(gone), alone, sum(m[1] for m in gone), sum(m[2] for m in gone)))
                shapley[f] += len(gone)
                left = stay
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_runs_every_order(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d$lta", f"w{rng.randrange(900)}", f"v{rng.randrange(900)}"]) if rng.random() < 0.4 else f"u{rng.randrange(9000)}" for _ in range(rng.choice([3, 99, 100, 140]))]
        rows.append((i, " ".join(words), rng.choice(["en", "de", "", None])))
    rows += [(1000 + k, rows[k % 5][1], rng.choice(["en", "fr"])) for k in range(40)]
    rows += [(7, rows[7][1], "en"), (None, rows[8][1], "en"), (None, None, None), (2000, None, "fr"), (2001, "", "fr"), (2002, " \t ", "fr")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 1040, 3)] + [(3, 1, 0), (3, 0, 0), (99_999, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(docs, marks).select(*AUDIT).collect()))
    assert got == plain_audit(rows, labels) and len(got) == 600 * 4


def test_audit_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(documents, labels).select(*AUDIT).collect()))
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect()], [(1, 1, 0)])
    clashing = documents.withColumns({"A": F.lit("x"), "part": F.lit("x"), "mask": F.lit(1), "good": F.lit(1)})
    assert sorted(map(tuple, filter_audit.audit(clashing, labels).select(*AUDIT).collect())) == got
    assert filter_audit.audit(documents.limit(0), labels).count() == 0
    assert filter_audit.audit(documents, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# -- packing --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def coder():
    return packing.Encoder(TOKENIZER)


def test_a_text_is_tokenised_in_one_call(coder, tokenizer, monkeypatch):
    """A call a distinct word cost more than the merges."""
    calls, core = [], coder.core

    class Counted:
        def encode_to_numpy(self, text, **given):
            calls.append(text)
            return core.encode_to_numpy(text, **given)

    monkeypatch.setattr(coder, "core", Counted())
    text = " ".join(f"w{i}ord  {i}\n né</s>" for i in range(500))
    assert coder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids and calls == [text]


def padding(n, window=packing.WINDOW):
    return 0 if n & (n - 1) == 0 else window - n


def test_ids_are_the_tokenizers(tokenizer, coder):
    rng = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "ß", "。", "'ll", "12", "<|endoftext|>", " ", " ", "　", "😀", "x.y", "!", "? ", " the", " Qu", "\r\n", "\x1f", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert coder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_the_corpus(sample, tokenizer, coder):
    for r in sample.select("text").collect():
        assert coder.ids(r.text or "").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def plain_cost(places, penalties, window):
    """The least cost by trying all pairs of cuts."""
    at, pen, best = [0, *places], [0, *penalties], [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + padding(at[j] - at[i], window) + pen[j] + packing.WINDOW_COST for i in range(j) if at[j] - at[i] <= window))
    return best[-1]


@pytest.mark.parametrize("seed", range(60))
def test_cuts_cost_least(seed):
    """Whatever is handed on early: the sum is the optimum."""
    rng, window = random.Random(seed), 64
    n = rng.randrange(1, 160)
    places = np.cumsum([rng.randrange(1, 30) for _ in range(n)])
    penalties = np.array([rng.choice([0.0, packing.SENTENCE_CUT, packing.HARD_CUT]) for _ in range(n)])
    packer, cuts, a = packing.Packer(window), [0], 0
    while a < n:
        b = min(n, a + rng.randrange(1, 40))
        packer.extend(places[a:b], penalties[a:b])
        cuts += packer.certain(final=b == n)[1:]
        a = b
    of = dict(zip(places.tolist(), penalties.tolist(), strict=True))
    assert cuts[-1] == places[-1] and all(0 < b - a <= window for a, b in zip(cuts, cuts[1:], strict=False))
    cost = sum(padding(b - a, window) + of[b] + packing.WINDOW_COST for a, b in zip(cuts, cuts[1:], strict=False))
    assert cost == pytest.approx(plain_cost(places, penalties, window))


def check_pieces(rows, texts, tokenizer, window=packing.WINDOW):
    """Every id in one piece, sequences without gaps; *texts*: Counter of (id, text)."""
    whole = {}
    for (_, text), _ in texts.items():
        whole[text] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_TOKEN]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    held, used = defaultdict(list), 0
    for key in sorted(sequences):
        at = 0
        for r in sorted(sequences[key], key=lambda r: r.offset):
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert r.offset == at and r.length == len(ids) > 0
            at += r.length
            held[r.doc_id].append((r.start, r.doc_tokens, ids))
        assert at == sequences[key][0].sequence_tokens <= window
        used += padding(at, window)
    for doc_id in {d for d, _ in texts}:
        # pieces of one document follow each other; of rows with one id, in any order
        parts, built = held.pop(doc_id), []
        if len({p[1] for p in parts}) == sum(n for (d, _), n in texts.items() if d == doc_id):
            for n in {p[1] for p in parts}:
                ids = []
                for start, _, more in sorted(p for p in parts if p[1] == n):
                    assert start == len(ids)
                    ids += more
                assert len(ids) == n
                built.append(ids)
            assert sorted(built) == sorted(whole[t] for (d, t), n in texts.items() if d == doc_id for _ in range(n))
        else:
            assert sum(len(p[2]) for p in parts) == sum(len(whole[t]) * n for (d, t), n in texts.items() if d == doc_id)
    assert not held
    return used


def test_every_id_is_in_one_piece(spark, sample, tokenizer):
    texts = Counter((r.doc_id, r.text) for r in sample.select("doc_id", "text").collect())
    rows = packing.pack_documents(sample, TOKENIZER, hand_on=5000).collect()
    tokens = sum(r.length for r in rows)
    assert check_pieces(rows, texts, tokenizer) < 0.01 * tokens
    # what is handed on early is what one pass over the whole partition finds
    assert {(r.doc_id, r.start, r.length, r.offset) for r in rows} == {(r.doc_id, r.start, r.length, r.offset) for r in packing.pack_documents(sample, TOKENIZER).collect()}


def test_packing_edges(spark, documents, tokenizer):
    texts = Counter((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    check_pieces(packing.pack_documents(documents, TOKENIZER).collect(), texts, tokenizer)
    check_pieces(packing.pack_documents(documents.withColumns({"ids": F.lit(1), "start": F.lit("x")}), TOKENIZER, window=128, hand_on=64).collect(), texts, tokenizer, 128)
    assert packing.pack_documents(documents.limit(0), TOKENIZER).count() == 0
    endless = spark.createDataFrame([(1, "x" * 300_000)], "doc_id long, text string")  # no blank, no sentence
    rows = packing.pack_documents(endless, TOKENIZER).collect()
    check_pieces(rows, Counter({(1, "x" * 300_000): 1}), tokenizer)


def test_packing_query(spark, sample, tokenizer):
    of = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in sample.select("doc_id", "text").collect()}
    rows = llm_queries.op12_packing(spark, FOLDER).collect()
    for r in rows:
        piece = np.array(of[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(of[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, of.values()))


# -- spelling variants ----------------------------------------------------------------------------


def plain_words(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return out


VARIANTS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("largest", [64, 3])
def test_variants_match_all_pairs(spark, largest):
    rng = random.Random(8)
    bases = ["straße", "garden", "gardens", "aaaaaa", "abcde", "élève", "schöne", "committee"]
    words = []
    for _ in range(900):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[p : p + (kind != 0)] = [] if kind == 1 else [rng.choice("abeéßx")]
        words += ["".join(w)] * rng.choice([1, 3, 7, 20])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i : i + 50])) for i in range(0, len(words), 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.group_variants(docs, largest=largest).select(*VARIANTS).collect()}
    assert got == plain_variants(plain_words(rows)) and max(r[2] for r in got) > 5


def test_blocks_hold_every_pair_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(500)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    scratch = Scratch(spark)
    rows = spelling.blocks(frame, scratch, 8).collect()
    scratch.remove()
    held = defaultdict(list)
    for r in rows:
        held[(r.edit, r.m, r.lo, r.hi, r.key)].append((r.word, r.n))
    found = Counter(tuple(sorted((a[0], b[0]))) for where, members in held.items() for a, b in spelling.pairs(*where[:4], members))
    assert set(found.values()) == {1}
    assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert all(len(m) <= 8 or where[3] - where[2] == 1 for where, m in held.items())


def test_words_match_plain_reading(spark, sample, documents):
    for docs in (sample, documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert {r.word: r.n for r in spelling.count_words(docs).collect()} == plain_words(rows)


def test_variants_edges(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    odd = [(None, "colour color colour colour color colouR colour"), (50, "×÷×÷× ×÷×÷× ×÷×÷×"), (51, "z" * 70_000 + " " + "z" * 70_000), (51, "z" * 70_000 + " coloré colors" * 9), (52, None)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"word": F.lit("x"), "n": F.lit(0), "key": F.lit(1)})
    got = {tuple(r) for r in spelling.group_variants(docs).select(*VARIANTS).collect()}
    assert got == plain_variants(plain_words(rows + odd))
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_long_chains_reach_their_root(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)] + [(f"s{i}", "w050") for i in range(30)], "word string, form string")
    scratch = Scratch(spark)
    got = {r.word: r.root for r in spelling.roots(links, scratch).collect()}
    scratch.remove()
    assert len(got) == 130 and set(got.values()) == {"w100"}


def test_spelling_query(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = {tuple(r) for r in llm_queries.op13_spelling(spark, FOLDER).select(*VARIANTS).collect()}
    n = plain_words(rows)
    by_cut = defaultdict(set)  # all pairs, by what is left when a letter goes
    for w in n:
        by_cut[(w, None)].add(w)
        for p in range(len(w)):
            by_cut[(w[:p] + w[p + 1 :], p)].add(w)
            by_cut[(w[:p] + w[p + 1 :], None)].add(w)
    near = defaultdict(set)
    for group in by_cut.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    assert {(g[0], g[1], g[2]) for g in got} == {(w, c, len(near[w])) for w, c in n.items()}
