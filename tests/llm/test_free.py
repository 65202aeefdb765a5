"""The other operators and the pipeline on edge cases and against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palaver.llm import decontaminate, html_extract, license_scan, simhash, toxicity
from palaver.llm import queries as llm_queries
from tests.llm.conftest import FOLDER

# -- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, most=4):
    """(id, fingerprint) pairs to the smallest id reachable, by all pairs."""
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= most:
                parent[root(i)] = root(j)
    best = {}
    for i, (ident, _) in enumerate(items):
        r = root(i)
        best[r] = ident if best.get(r) is None else best[r] if ident is None else min(best[r], ident)
    return [best[root(i)] for i in range(len(items))]


def test_simhash_matches_brute_force(spark, sample):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in sample.collect()]
    want = dict(zip([i for i, _ in rows], plain_components(rows), strict=True))
    for points in (65_536, 16):
        got = simhash.near_duplicate_groups(sample, shard_points=points).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.fp % 2**64 for r in got} == dict(rows)


def test_tree_search_finds_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = base[:400]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, np.arange(40, dtype=np.uint64)]))
    forest = simhash.Forest(len(points))
    forest.join(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4))
    want = forest.labels()
    tree = simhash.build_tree(points, 4, 4, rng)
    idx, shard, home = simhash.route(tree, points, 4)
    assert home.sum() == len(points) and simhash.leaves(tree) > 8
    got = simhash.Forest(len(points))
    for s in np.unique(shard):
        own = np.concatenate([idx[(shard == s) & home], idx[(shard == s) & ~home]])
        label = simhash.search(points[own], int(((shard == s) & home).sum()), 4)
        got.join(own, own[label])
    assert np.array_equal(got.labels(), want)


def test_components_of_long_paths(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200)[::-1], (300, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_simhash_edges(spark, documents):
    got = simhash.near_duplicate_groups(documents).collect()
    assert len(got) == 12
    assert {r.component_id for r in got if r.fp == 0} == {3}  # null, empty and blank texts
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == [(False, i) for i in (1, 3, 5, 6, 8, 9)] + [(True, None)]
    assert simhash.near_duplicate_groups(documents.limit(0)).count() == 0 and simhash.drop_near_duplicates(documents.limit(0)).count() == 0


def plain_similarity(a, b, size=5):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


@pytest.mark.parametrize("members", [20_000, 2])
def test_near_duplicate_stage_finds_all_pairs_of_similar_shingles(spark, sample, monkeypatch, members):
    """Buckets whole, and split into parts of two."""
    import corpus_pipeline as cp
    from palaver.llm import shingle_join

    monkeypatch.setattr(shingle_join, "PART_MEMBERS", members)

    rng, texts = random.Random(8), [r.text for r in sample.limit(60).collect()]
    for k in range(40):  # edited copies around the threshold, and a chain of edits
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(words))
        for _ in range(4):
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice((30, 50, 80)))):
                words[at] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    marks = [plain_fingerprint(t, 5) for t in texts]
    linked = lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4 or plain_similarity(texts[i], texts[j]) >= 0.8
    least = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if linked(i, j)]
    while any(least[i] != least[j] for i, j in pairs):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    assert sum((marks[i] ^ marks[j]).bit_count() > 4 for i, j in pairs) > 20
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], sample.schema)
    kept = cp.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least))


# -- decontamination ------------------------------------------------------------------------------


def plain_hits(text, items, window):
    words = decontaminate.word_bytes(text).split()
    hit, found = set(), set()
    for ident, t in items:
        iw = decontaminate.word_bytes(t).split()
        m = min(window, len(iw))
        for k in range(len(iw) - m + 1 if m else 0):
            for p in range(len(words) - m + 1):
                if words[p : p + m] == iw[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add("" if ident is None else str(ident))
    return len(words), hit, sorted(found)


def test_windows_match_brute_force():
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d", "é", "X", "1z", "a-b"]
    for trial in range(150):
        items = [(rng.choice([i, None]), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(rng.choice([1, 3, 6]))]
        docs = [rng.choice([None, "", " ".join(rng.choices([*vocabulary, "q"], k=rng.randrange(30)))]) for _ in range(5)] + [f"q {items[0][1]}, {items[0][1]} q"]
        compiled = decontaminate.compile_windows(items, 1 + trial % 4)
        if compiled is None:
            continue
        for text, (n, spans, found) in zip(docs, decontaminate.scan_texts(docs, compiled, rng.choice([5, 40, 1000])), strict=True):
            assert (n, {p for a, b in spans for p in range(a, b)}, found) == plain_hits(text, items, 1 + trial % 4)


def test_contamination_query_matches_brute_force(spark, sample, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    whole = {}
    for ident, t in items:  # windows by content, to look up
        w = decontaminate.word_bytes(t).split()
        for k in range(max(1, len(w) - 9)):
            whole.setdefault(tuple(w[k : k + 10]), set()).add(str(ident))
    for blocks in (decontaminate.BLOCK_BYTES, 3000):  # one block of the benchmark, and several
        got = {r.doc_id: r for r in decontaminate.find_contamination(sample, benchmark, block_bytes=blocks).collect()}
        for r in sample.collect():
            w = decontaminate.word_bytes(r.text).split()
            hit, found = set(), set()
            for p in range(len(w) - 9):
                if tuple(w[p : p + 10]) in whole:
                    hit |= set(range(p, p + 10))
                    found |= whole[tuple(w[p : p + 10])]
            g = got[r.doc_id]
            assert (g.n_words, g.n_hit, g["items"]) == (len(w), len(hit), sorted(found))


def test_removal_leaves_no_window(spark, documents):
    rows = [(9, "one two three four five six seven eight nine ten eleven"), (None, "beta gamma delta epsilon"), (2, None), (3, "...")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    text = "Start. One two, three four five six seven eight nine TEN eleven! End"
    docs = spark.createDataFrame([(1, text, "s", 7), (2, "one two three four five six seven eight nine ten", "s", 7), (3, "clean text", "s", 7), (4, None, "s", 7)], "doc_id long, text string, n_hit_words string, n_chars int")
    got = {r.doc_id: r for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert sorted(got) == [1, 3, 4] and got[1].text == "Start. ! End" and got[3].text == "clean text"
    out = decontaminate.remove_contamination(documents, bench)
    assert out.columns[:-1] == documents.columns and out.filter("text LIKE '%beta gamma delta epsilon%'").count() == 0
    assert decontaminate.find_contamination(documents, bench).count() == 12
    none = decontaminate.find_contamination(documents, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontaminate.find_contamination(documents.limit(0), bench).count() == 0
    assert decontaminate.remove_contamination(documents, bench.limit(0)).count() == 12


# -- toxicity -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = llm_queries.op5_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(toxic) > 100 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    above = np.mean([[(t.score > c.score) + 0.5 * (t.score == c.score) for c in clean[:400]] for t in toxic])
    assert above > 0.93 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert docs.count() == 10_000


def test_labels_of_the_held_out_third_are_unused(spark, sample):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity.training_rows(sample, labels, lambda i: llm_queries.third(i) != 1)
    assert rows and all(zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in rows)


def test_scores_match_plain_compression(spark, sample):
    """Given the model, every document's score by compressing each word afresh."""
    import math

    import zstandard

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)

    def size(raw, part):
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=20, hash_log=17, chain_log=17, search_log=6, target_length=64,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress(b"<window of text>" + part + b"0123456789ABCDEF"))

    def evidence(word):
        parts = [b"\n\n\n" + word + b"\n"] + ([b"\n\n\n" + word[:7]] if len(word) > 7 else [])
        return max(size(model.ordinary, p) - size(model.toxic, p) for p in parts)

    rows = sample.orderBy(F.length("text")).limit(8).unionByName(sample.filter("text RLIKE 'idiot|stupid|scum'").orderBy(F.length("text")).limit(2))
    for r in toxicity.score_documents(rows, model).collect():
        low = "".join(c if c.isascii() and c.islower() or not c.isascii() else " " for c in (r.text or "").lower())
        top = sorted((evidence(w.encode()) for w in set(low.split())), reverse=True)
        want = 0.01
        if len(top) >= model.needed:
            least, strong = top[model.needed - 1], sum(e >= model.cut for e in top)
            level = math.log(0.7 / 0.3) + 0.9 * (least - model.cut + 0.5) + 0.15 * math.log1p(strong)
            level = level if least >= model.cut else min(level, math.log(0.7 / 0.3) - 0.2)
            want = 0.01 + 0.98 / (1 + math.exp(-level))
        assert abs(r.score - want) < 1e-9


def test_toxicity_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents, none) is None
    assert {r.score for r in toxicity.score_documents(documents, None, score_col="s2").select(F.col("s2").alias("score")).collect()} == {0.01}
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefg", k=6))
    rows = [(i, " ".join([word() for _ in range(30)] + ["vileword"] * (i % 4 == 0))) for i in range(400)]
    model = toxicity.train([(i, t, int(i % 4 == 0)) for i, t in rows])
    scorer = toxicity.Scorer(model)
    assert scorer.score("some Vileword here") >= 0.7 > scorer.score("some plain text here") > 0 and 0 < scorer.score(None) < 0.7
    out = toxicity.score_documents(documents, model)
    assert out.columns[:-1] == documents.columns and out.count() == 12
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(documents, labels, lambda i: F.lit(True)) == []
    assert toxicity.drop_toxic(documents.limit(0), labels).count() == 0 and toxicity.drop_toxic(documents, labels).columns == documents.columns


# -- licenses -------------------------------------------------------------------------------------


def test_patience_alignment():
    assert license_scan.longest_increasing([5, 1, 2, 9, 3]) == [1, 2, 4]
    a, b = "x a b c y d e".split(), "a b q c d e".split()
    pairs = license_scan.patience_align(a, b)
    assert [a[i] for i, _ in pairs] == ["a", "b", "c", "d", "e"] and all(a[i] == b[j] for i, j in pairs)
    for _ in range(50):
        rng = random.Random(_)
        a, b = rng.choices("abcde", k=12), rng.choices("abcde", k=9)
        pairs = license_scan.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_each_license_is_found(name):
    compiled = license_scan.compile_templates(license_scan.TEMPLATES)
    text = license_scan.TEMPLATES[name]
    noisy = " ".join(w for k, w in enumerate(text.split()) if k % 12 != 5)
    doc = "The words of a text come first and go on. " * 6 + text.upper() + "\nmore of the same text. " * 4 + noisy + "\nThe end."
    found = license_scan.find_licenses(doc, compiled)
    assert [f[2] for f in found] == [name, name] and found[0][3] == 1.0
    assert doc[found[0][0] : found[0][1]].split()[0].lower() == text.split()[0].lower()


def test_two_edited_copies_of_a_license_are_both_found():
    compiled = license_scan.compile_templates(license_scan.TEMPLATES)
    words = license_scan.TEMPLATES["MIT"].split()
    once = [i for i, w in enumerate(words) if words.count(w) == 1]
    for seed in range(100):
        rng, copies = random.Random(seed), []
        for k in range(2):
            copy = list(words)
            copy[rng.choice(once)] = f"edit{k}"
            copies.append(" ".join(copy))
        found = license_scan.find_licenses(copies[0] + "".join(f" gap{i}" for i in range(15)) + " " + copies[1], compiled)
        assert [f[2] for f in found] == ["MIT", "MIT"] and min(f[3] for f in found) > 0.97


def longest_common(a, b):
    """The length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_license_coverage_matches_dynamic_programming():
    """What the alignment covers of edited notices is what plain dynamic programming covers, or nearly so."""
    compiled = license_scan.compile_templates(license_scan.TEMPLATES)
    rng = random.Random(12)
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        if len(words) < 30 or name == "BSD-2-Clause":  # most of BSD-3-Clause
            continue
        for _ in range(3):
            copy = [f"x{rng.randrange(999)}" if rng.random() < 0.06 else w for w in words if rng.random() > 0.04]
            doc = " ".join([f"a{k}" for k in range(40)] + copy + [f"b{k}" for k in range(40)])
            found = [f for f in license_scan.find_licenses(doc, compiled) if f[2] == name]
            low = lambda ws: re.findall(r"[a-z0-9]+", " ".join(ws).lower())
            best = longest_common(low(doc.split()), low(words)) / len(low(words))
            if best >= 0.84:
                assert len(found) == 1 and best - 0.03 <= found[0][3] <= best + 1e-9, (name, best, found)


def test_license_scan_matches_known_lines(spark, sample, documents):
    lines = {"GPL-3.0-name", "MIT-name", "CC-BY-NC-4.0-name", "Apache-2.0-name"}
    got = {r.doc_id: Counter(f.license for f in r.found) for r in license_scan.scan_licenses(sample).collect()}
    for r in sample.collect():
        want = Counter({n: r.text.count(license_scan.TEMPLATES[n]) for n in lines})
        assert got[r.doc_id] == +want
    assert license_scan.scan_licenses(documents).count() == 12 and license_scan.scan_licenses(documents.limit(0)).count() == 0


# -- HTML -----------------------------------------------------------------------------------------


def test_pages_match_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))
        assert got[r.page_id] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def story_page(k, rng, constant="Read by many, every day"):
    """A page without any label: menus and teasers that vary, a constant strap, a story of paragraphs, a constant line in it."""
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    links = "".join(f"<li><a href='/{word()}'>{word()} {word()}</a></li>" for _ in range(8))
    said = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(2, 6))]
    extra = f"<div><div><a href=x>{word()}</a></div></div>" if k % 3 == 0 else ""
    page = (
        f"<html><head><title>{word()}</title></head><body><div><span>{constant}</span></div>{extra}<div><ul>{links}</ul></div>"
        f"<div><h2>Title {k}</h2>{''.join(f'<p>{p}</p>' for p in said)}<p>Share this with <b>friends {k}</b></p><em>All rights kept</em></div>"
        f"<div><ul><li><a href=y>{word()}</a></li><li><a href=z>{word()} {k}</a></li></ul></div></body></html>"
    )
    return page, "\n".join([f"Title {k}", *said, f"Share this with friends {k}"])


def test_wrapper_decides_where_nothing_is_labelled(spark):
    rng = random.Random(5)
    pages = [story_page(k, rng) for k in range(60)]
    df = spark.createDataFrame([(k, f"http://h/{k}", p) for k, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    for k, (page, want) in enumerate(pages):
        assert got[k] == want
        assert "Read by many" in html_extract.extract(page) and "All rights kept" in html_extract.extract(page)
    three = {r.page_id: r.text for r in html_extract.extract_pages(df.filter("page_id < 2")).collect()}
    assert all("Read by many" in t and f"Title {k}" in t for k, t in three.items())  # too few pages for a template


def test_wrappers_alone_find_nearly_every_article(spark):
    """Without any name the host's pages say what is article, menu and footer: the same text on 95 pages of 100 and more."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    named = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    bare = {r.page_id: r.text for r in html_extract.extract_pages(pages, names=False).collect()}
    assert len(named) == 2500 and sum(bare[k] == t for k, t in named.items()) > 0.95 * len(named)
    plain = sum(html_extract.extract(r.html) == bare[r.page_id] for r in pages.limit(200).collect())
    assert plain > 180  # as by the names of a single page


def test_names_that_mislead_can_be_left_out(spark):
    """The story is called a sidebar, the menu an article; its adverts vary."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    said = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k in range(40):
        story = [said(rng.randrange(10, 60)) for _ in range(rng.randrange(2, 6))]
        links = "".join(f"<li><a href=/{word()}>{said(2)}</a></li>" for _ in range(6))
        page = f"<body><article><ul>{links}</ul></article><div class=box>{said(6)}</div><aside class=sidebar><h2>Title {k}</h2>{''.join(f'<p>{p}</p>' for p in story)}</aside><section>made by {word()}</section></body>"
        rows.append((k, f"http://h/{k}", page))
        want[k] = "\n".join([f"Title {k}", *story])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_pages(df, names=False).collect()} == want
    assert {r.page_id: r.text for r in html_extract.extract_pages(df).collect()} != want


def test_a_page_of_another_layout_is_read_whole(spark):
    """The story's place holds little of it."""
    page = lambda k: f"<body><div><p>Story {k} {'word ' * 40}{k}</p></div><section>{k}</section></body>"
    odd = f"<body><div><p>x</p></div><section>{'other ' * 50}</section></body>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(20)] + [(99, "http://h/99", odd)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith(f"Story {k} ") and "\n" not in got[k] for k in range(20)) and "other other" in got[99]


def test_template_is_counted_over_all_pages(spark):
    """A notice on nine of ten pages goes; a paragraph on a few, sampled or not, stays; copies of a page tell nothing."""
    def page(k):
        notice = "We are read by many" if k % 10 else f"Other words {k}"
        shared = "A paragraph that some share" if k % 4 == 0 else f"A paragraph of page {k}"
        return f"<body><div class=story><h2>Title {k}</h2><p>{shared}</p><b>{notice}</b></div></body>"

    rows = [(k, "http://h/" + str(k), page(k)) for k in range(200)] + [(1000 + k, "http://g/", page(7)) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    for k in range(200):
        want = [f"Title {k}", "A paragraph that some share" if k % 4 == 0 else f"A paragraph of page {k}"]
        assert got[k].split("\n") == want + ([] if k % 10 else [f"Other words {k}"])
    assert {got[1000 + k] for k in range(50)} == {"Title 7\nA paragraph of page 7\nWe are read by many"}


def plain_matching(a, b):
    """Simple tree matching by the textbook's table."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_matching(x, y))
    return 1 + m[-1][-1]


def test_alignment_is_simple_tree_matching():
    rng = random.Random(11)

    def tree(depth):
        below = [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []
        return html_extract.Slot(rng.choice("ab"), [], below)

    for _ in range(200):
        a, b = tree(3), tree(3)
        pairs = html_extract.align(a.children, b.children, {})
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        if [x.label for x in a.children] != [x.label for x in b.children]:
            value = sum(html_extract.score(a.children[i], b.children[j], {}) for i, j in pairs)
            assert all(a.children[i].label == b.children[j].label for i, j in pairs) and value <= plain_matching(a, html_extract.Slot(a.label, [], b.children)) - 1
    x = [html_extract.Slot(c, [], []) for c in "abcbdab"]
    y = [html_extract.Slot(c, [], []) for c in "bdcaba"]
    assert len(html_extract.align(x, y, {})) == 4  # the longest common subsequence


def test_deep_and_wide_pages(spark):
    import time

    deep = "<div>" * 5000 + "<article>" * 30 + "deep text" + "</div>" * 5000
    nested = "".join("<article class=comment>" for _ in range(3000)) + "x"
    wide = "<body><div class=story>" + "".join(f"<h2>Head {k}</h2><p>Para {k}</p>" for k in range(5000)) + "</div></body>"
    blocks = "<body>" + "".join(f"<div><div>{k}</div></div><section>{k}</section>" for k in range(5000)) + "</body>"
    began = time.time()
    assert html_extract.extract(deep) == "deep text" and html_extract.extract(nested) == ""
    assert html_extract.extract(wide).count("\n") == 9999
    rows = [(k, "http://h/a", p + f"<p>{k}</p>") for k, p in enumerate([deep, nested, wide, blocks] * 2)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 8 and sum("Para 4999" in r.text for r in got) == 2 and time.time() - began < 60


def test_inside_the_article_only_named_parts_go():
    page = "<article><p>a</p><p class='legal'>b</p><div class='search'>c</div><div class=ad>d</div><div class='comments'>e</div><div id=related>f</div></article><div class=related>g</div>"
    assert html_extract.extract(page) == "a\nb\nc\nf"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<b>c</p>d", "a\nbc\nd"), ("<article><header><h1>T</h1></header>x</article><footer>f", "T\nx"),
        ("<header>h</header><main><p>m</p><nav>n</nav></main>", "m"), ("<p>a</p><script>var x='</p>'</script><style>s", "a"), ("a<!-- x --> b<![CDATA[c]]><p", "a bc"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<div class='ad-banner'>x</div><p>y &copy; &#65; &am", "y © A &am"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
        ("<body class='has-sidebar'><div class='sidebar-wrap'><article class='post comments-open'>x</article></div><div id=sidebar>s</div>", "x"),
        ("<article>x<article class=comment>c</article></article>", "x"),
    ],
)
def test_broken_and_marked_up_html(html, want):
    assert html_extract.extract(html) == want


def test_html_edges(spark):
    rows = [(1, None, "<p>x</p>", "c"), (2, "http://h/a", None, "c"), (2, "http://h/a", None, "c"), (None, "notaurl", "<p>" + "w " * 100_000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("hash", F.lit(1)).withColumn("wrapper", F.lit("w"))
    got = html_extract.extract_pages(df).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 1, 199_999] and html_extract.extract_pages(df.limit(0)).count() == 0


def test_wrappers_by_join_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    held = {(r.page_id, r.text) for r in html_extract.extract_pages(pages).collect()}
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert {(r.page_id, r.text) for r in html_extract.extract_pages(pages).collect()} == held


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sample, benchmark):
    import corpus_pipeline as cp
    from palaver.llm import line_dedup
    from tests.llm.test_native import plain_line_dedup

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs, seen = sample, {}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys()
        seen[name] = (before, after)
        docs = spark.createDataFrame(list(after.values()), sample.schema)
    rows = toxicity.training_rows(sample, labels, lambda i: llm_queries.third(i) != 1)
    model = toxicity.train(rows)
    before, after = seen["toxicity"]
    scorer = model and toxicity.Scorer(model)
    assert after.keys() == {i for i, r in before.items() if scorer is None or scorer.score(r.text) < 0.7}
    before, after = seen["line_dedup"]
    plain = dict(zip(before, plain_line_dedup([(i, r.text, r.source) for i, r in before.items()], line_dedup.RATIO, line_dedup.MIN_PAGES), strict=True))
    assert {i: r.text for i, r in after.items()} == {i: t for i, t in plain.items() if t == before[i].text or t.strip()}
    before, after = seen["simhash_near_dedup"]
    ids, least = list(before), {i: i for i in before}
    marks = {i: plain_fingerprint(before[i].text, 5) for i in ids}
    links = [(i, j) for k, i in enumerate(ids) for j in ids[:k] if (marks[i] ^ marks[j]).bit_count() <= 4 or plain_similarity(before[i].text, before[j].text) >= 0.8]
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert after.keys() == set(least.values())
    before, after = seen["benchmark_decontamination"]
    windows = decontaminate.compile_windows([(r.item_id, r.text) for r in benchmark.collect()])
    assert not any(len(s) for _, s, _ in decontaminate.scan_texts([r.text for r in after.values()], windows))
    clean = {i for i, (_, s, _) in zip(before, decontaminate.scan_texts([r.text for r in before.values()], windows), strict=True) if not len(s)}
    assert all(after[i] == before[i] for i in clean) and all(r.n_chars == len(r.text) for r in after.values())
    mixed = cp.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id: r.text for r in mixed}.items() <= {i: r.text for i, r in after.items()}.items() and all(1 <= r.copies <= 2 for r in mixed)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, FOLDER).collect()
    assert 0 < len(out) <= 200 and cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "toxicity"


def test_stages_take_empty_and_odd_documents(spark, documents, tmp_path):
    import corpus_pipeline as cp

    for frame in (documents.limit(0), documents):
        for name, stage in cp.STAGES:
            out = stage(spark, frame, FOLDER)
            assert (out.count() > 0) == (frame is documents), name


def test_copies_of_a_clean_document_reach_the_mix(spark, sample):
    import corpus_pipeline as cp

    clean = "\n".join(f"Sentence {k} of a clean document that {k * 7} people copied." for k in range(6))
    menu = "home about contact"  # a page of boilerplate alone, copied too
    rows = [(i, f"{menu}\nThe page {i} tells of {i * 31} things and of {i * 17} others.", "en", f"s{i % 2}") for i in range(100)]
    rows += [(1000 + i, clean, "en", f"s{i % 2}") for i in range(60)] + [(2000 + i, menu, "en", "s0") for i in range(8)] + [(3000, menu + "\n" + menu, "en", "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], sample.schema)
    out = {r.doc_id: r for r in cp.drop_boilerplate_lines(spark, docs, FOLDER).collect()}
    assert all(out[1000 + i].text == clean for i in range(60))
    assert all(out[i].text == rows[i][1].split("\n")[1] and out[i].n_chars == len(out[i].text) for i in range(100))
    assert {i for i in out if i >= 2000} == {2000} and out[2000].text == menu
    kept = cp.drop_near_duplicates(spark, spark.createDataFrame(list(out.values()), sample.schema), FOLDER)
    assert [r.doc_id for r in kept.collect() if r.text == clean] == [1000]
