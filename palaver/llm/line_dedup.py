"""Line dedup by site-relative frequency.

A line is boilerplate of a host if the pages of the host that hold it, divided by all pages of the host, exceed ``ratio``,
and it repeats (``min_pages`` of 2: one page alone repeats nothing).  Such lines are dropped from every page of the host.
Rows of a host with one text are one page, so a text is not boilerplate for having been copied.

Lines are compared after trimming; blank lines are never boilerplate.  Counting works on 128-bit line hashes with
partial aggregation, so a hot host or line is a sum; each page also counts once for its host in the same pass.  A host's
boilerplate is at most its lines per page divided by the ratio.  Where all of it is small (``BROADCAST_LINES`` in all,
``HOST_LINES`` a host) it is broadcast and texts are cleaned where they are read; beyond that, the hashes to drop come
back to a text by a shuffle, as the few that concern it.

Edge cases: null texts stay null and count as pages without lines; null hosts form one host; a page that repeats a line
counts once for it; repeated rows are one page and both stay; a text all of whose lines go becomes empty and stays; a
very long text is split and hashed whole, in one task; an empty table gives no rows; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import fresh, materialize, text_or_empty

RATIO = 0.05
MIN_PAGES = 2
BLANKS = " \t\n\x0b\x0c\r"
#: Boilerplate lines in all (of about 50 bytes), and of the host with most, up to which they are broadcast.
BROADCAST_LINES, HOST_LINES = 200_000, 5_000


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """16 bytes of the trimmed line; null for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def line_hashes(text: Column) -> Column:
    """The distinct hashes of a text's lines."""
    return F.filter(F.array_distinct(F.transform(lines(text), line_hash)), lambda h: h.isNotNull())


def page_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, line, pages, host_pages) of the lines to drop."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(host_col).cast("string").alias("host"), page_key(text).alias("page"), line_hashes(text).alias("held"))
    pages = rows.groupBy("host", "page").agg(F.first("held").alias("held"))  # the hashes move, not the texts
    # a null line stands for the page itself
    counts = pages.select("host", F.explode(F.array_append("held", F.lit(None).cast("binary"))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counts = materialize(counts.filter(F.col("line").isNull() | (F.col("pages") >= min_pages)))
    totals = counts.filter("line IS NULL").select(F.col("host").alias("of"), F.col("pages").alias("host_pages"))
    common = counts.filter("line IS NOT NULL").join(totals, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return common.filter(F.col("pages") > F.col("host_pages") * ratio).select("host", "line", "pages", "host_pages")


def drop_boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source",
    broadcast_lines: int = BROADCAST_LINES, host_lines: int = HOST_LINES,
) -> DataFrame:
    """The documents without their hosts' boilerplate lines, and the column ``dropped_lines``."""
    common = materialize(boilerplate(docs, ratio, min_pages, text_col, host_col).select("host", "line"))
    sizes = common.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("lines"), F.max("n").alias("most")).first()
    of, drops, out = fresh("__host", docs), fresh("__drops", docs), fresh("dropped_lines", docs)
    text, host = F.col(text_col), F.col(host_col).cast("string")
    if (sizes["lines"] or 0) <= broadcast_lines and (sizes["most"] or 0) <= host_lines:
        of_host = common.groupBy(F.col("host").alias(of)).agg(F.collect_list("line").alias(drops))
        joined = docs.join(F.broadcast(of_host), host.eqNullSafe(F.col(of)), "left").drop(of)
        joined = joined.withColumn(drops, F.when(F.col(drops).isNotNull(), F.array_intersect(line_hashes(text), F.col(drops))))
    else:
        key, line = fresh("__page", docs), fresh("__line", docs)
        found = docs.select(host.alias("h"), page_key(text).alias("p"), F.explode(line_hashes(text)).alias(line)).distinct()
        held = found.join(common, F.col("h").eqNullSafe(F.col("host")) & (found[line] == common["line"]), "left_semi")
        of_page = held.groupBy(F.col("h").alias(of), F.col("p").alias(key)).agg(F.collect_list(line).alias(drops))  # lines of one text
        joined = docs.join(of_page, host.eqNullSafe(F.col(of)) & (page_key(text) == F.col(key)), "left").drop(of, key)
    kept = F.filter(lines(text), lambda x: ~F.coalesce(F.array_contains(F.col(drops), line_hash(x)), F.lit(False)))
    some = F.coalesce(F.size(drops) > 0, F.lit(False))
    split = joined.withColumn(out, F.when(some, F.size(lines(text)) - F.size(kept)).otherwise(F.lit(0)))
    return split.withColumn(text_col, F.when(some, F.array_join(kept, "\n")).otherwise(text)).drop(drops)
