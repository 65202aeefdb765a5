"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import chat_format, decontaminate, exact_dedup, filter_audit, html_extract, license_scan, line_dedup, mixing, packing, secret_scan, simhash, spelling, toxicity
from palaver.llm.common import load


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve_duplicates(load(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_secrets(load(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.span_list(F.col("found"), base), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("found")).alias("spans"),
    )


def _op2_sql() -> str:
    """Pieces between matches and matches alternate; their running lengths are the positions."""
    parts = []
    for pos, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        keep = f"WHERE regexp_matches(g, '{rule.keep}')" if rule.keep else ""
        parts.append(f"""
  SELECT doc, '{rule.kind}' AS kind, {pos} AS pos, {str(rule.base).lower()} AS base, s AS start, s + len(m) AS stop FROM (
    SELECT doc, m, g, sum(len(gap) + len(m)) OVER (PARTITION BY doc ORDER BY i) - len(m) AS s FROM (
      SELECT doc, unnest(f) AS m, unnest(gs) AS g, unnest(p[1:len(f)]) AS gap, unnest(range(len(f))) AS i FROM (
        SELECT doc, regexp_extract_all(text, '{pattern}', 0) AS f, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs,
               string_split_regex(text, '{pattern}') AS p
        FROM d WHERE regexp_matches(text, '{pattern}')))) {keep}""")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS doc, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
per AS (
  SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, pos) FILTER (base) AS base_spans,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, pos) AS spans
  FROM spans GROUP BY doc)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(load(spark, sf_dir, "documents"))
    parts = F.transform("found", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("found.coverage"), F.lit(0.0)), 6).alias("best_coverage"),
        F.array_join(parts, ",").alias("spans"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string"
    )
    examples = chat_format.format_conversations(turns.unionByName(extra))
    trained = F.when(
        F.col("trainable"), chat_format.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    )
    read = examples.select("conv_id", "example", "formatted", trained.alias("trained")).groupBy("conv_id")
    per = read.agg(
        F.max_by("formatted", "example").alias("last"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("trained").isNotNull(), F.struct("example", "trained")))),
                lambda x: x["trained"],
            ),
            "",
        ).alias("loss"),
    )
    turns_read = per.withColumn("turns", chat_format.parse_formatted(F.col("last")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns_read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )


# A turn takes its marks, role and text, and one more character for each control string in it; the text of
# a turn stands in its own example and in that of every later target.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         len('<|im_start|><|im_end|>') + 2 + len(role) + len(text)
         + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|/?s>|</?SYS>>|/?INST\])')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
         role = 'assistant' OR k = n AS shown FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (shown))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def third(doc_id):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), usable=lambda i: third(i) != 1)
    held_out = F.coalesce(third(F.col("doc_id")) == 1, F.lit(False))
    scored = toxicity.score_documents(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# Sources by how soon they reach their stop for each unit of weight; all before the water level are capped.  The odds of
# a document are its size; rows that are alike are peers, and the default frame of the running sum ends after them.
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(sha256('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2, 52) AS u FROM documents),
s AS (SELECT *, source_size * {mixing.MOST_COPIES}::DOUBLE AS stop, [{', '.join(f'{w}::DOUBLE' for w in mixing.WEIGHTS)}][1 + pos % {len(mixing.WEIGHTS)}] AS weight FROM
    (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source)),
l AS (SELECT *, stop / weight AS level, (sum(source_size) OVER ()) * {mixing.SHARE}::DOUBLE - sum(stop) OVER w + stop AS rest_budget,
    sum(weight) OVER () - sum(weight) OVER w + weight AS shares FROM s WINDOW w AS (ORDER BY stop / weight, pos)),
c AS (SELECT *, rest_budget * weight >= stop * shares AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped OR unit IS NULL THEN stop ELSE least(stop, unit * weight) END AS target
    FROM c, (SELECT arg_min(rest_budget / shares, struct_pack(level, pos)) AS unit FROM c WHERE NOT capped)),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole,
    CASE WHEN size > 0 THEN u / (1 - u) / size::DOUBLE ELSE 'infinity'::DOUBLE END AS pareto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto, doc_id NULLS FIRST, size) AS run, greatest(0, target - whole * source_size) AS rest FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (whole + CASE WHEN rest > 0 AND run - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, words, least({decontaminate.WINDOW}, len(words)) AS m FROM (SELECT item_id, {_WORDS} AS words FROM benchmark)),
win AS (SELECT DISTINCT m, array_to_string(words[k:k + m - 1], ' ') AS g, item_id FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS k FROM b WHERE m > 0)),
grams AS (SELECT doc, m, p, array_to_string(words[p:p + m - 1], ' ') AS g FROM (SELECT doc, words, m, unnest(range(1, len(words) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(words) >= m)),
found AS (SELECT doc, p, m, item_id FROM grams JOIN win USING (m, g)),
h AS (SELECT doc, count(DISTINCT w) AS n_hit FROM (SELECT doc, unnest(range(p, p + m)) AS w FROM (SELECT DISTINCT doc, p, m FROM found)) GROUP BY doc),
i AS (SELECT doc, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc, item_id FROM found) GROUP BY doc)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc) LEFT JOIN i USING (doc)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(load(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("dropped_lines").cast("long").alias("n_dropped"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc, text, source, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT *, string_split(text, chr(10)) AS a FROM d)),
b AS (SELECT doc, text, source, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
h AS (SELECT source, count(DISTINCT text) AS host_pages FROM d GROUP BY source),
c AS (SELECT b.source, bare FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source WHERE bare <> ''
      GROUP BY b.source, bare, host_pages
      HAVING count(DISTINCT text) >= {line_dedup.MIN_PAGES} AND count(DISTINCT text) > host_pages * {line_dedup.RATIO}),
k AS (SELECT doc, count(c.bare) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.bare IS NULL), '') AS kept
      FROM b LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.bare = c.bare GROUP BY doc)
SELECT doc_id, n_dropped, len(kept) AS n_chars_kept, sha256(kept) AS text_sha256 FROM d JOIN k USING (doc)
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(load(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(load(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("filter")


# Straight from the conditions: the failures of a group of documents as bits, met with the filters before and after each step.
OP11_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens",
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(load(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_license_scan": op3_license_scan,
        "op4_chat_format": op4_chat_format,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_simhash": op10_simhash,
        "op11_filter_audit": op11_filter_audit,
        "op12_packing": op12_packing,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_secret_scan": _op2_sql(),
        "op4_chat_format": OP4_SQL,
        "op6_mixing": OP6_SQL,
        "op7_decontamination": OP7_SQL,
        "op8_line_dedup": OP8_SQL,
        "op11_filter_audit": OP11_SQL,
    }
