"""Cleaning and structure over lines and blocks: margins, repeats, islands, levels, reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.blocks import Box, reading_order
from docquarry.functions.text import list_marker

# Bands, zones and thresholds of page furniture.
BROWSER_TOP, BROWSER_BOTTOM, BROWSER_SIZE = 28.0, 35.0, 9.0
NUMBER_MARGIN = 0.15
REPEAT_PAGES, REPEAT_SHARE, REPEAT_BUCKET, REPEAT_TOP, REPEAT_BOTTOM = 3, 0.5, 4.0, 0.12, 0.20
HEADING_RATIO = 1.15
# Fixed value: how page numbers are written.
PAGE_NUMBER = r"(?i)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$"
# What a heading may be, at most.
HEADING_LINES, HEADING_CHARS, HEADING_WORDS = 3, 160, 25


def clean_lines(lines: DataFrame, pages: DataFrame, browser_chrome: Column | bool = True, patterns: list[str] = ()) -> DataFrame:
    """Adds removed, the first reason that holds of: icon_or_empty, browser_header_footer, page_number,
    repeated_boilerplate, override_pattern. Lines (doc_id, page, seq, y0, y1, size, text), pages (doc_id, page, height).

    A bare number in the margin is a page number if its distance to the page's own number occurs twice in the document.
    A text at about the same height on enough pages is boilerplate; heights are counted in three neighbouring buckets.
    """
    w = lines.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    n_pages = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    w = w.join(n_pages, "doc_id")
    w = w.withColumn("r1", F.when(F.col("text") == "", "icon_or_empty"))
    chrome = F.lit(browser_chrome) & (F.col("size") <= BROWSER_SIZE) & ((F.col("y1") <= BROWSER_TOP) | (F.col("y0") >= F.col("height") - BROWSER_BOTTOM))
    w = w.withColumn("r2", F.coalesce("r1", F.when(chrome, "browser_header_footer")))
    margin = F.col("height") * NUMBER_MARGIN
    numbered = F.col("r2").isNull() & F.col("text").rlike(PAGE_NUMBER) & ((F.col("y1") <= margin) | (F.col("y0") >= F.col("height") - margin))
    offset = F.when(numbered, F.regexp_extract("text", r"\d+", 0).try_cast("int") - F.col("page"))
    w = w.withColumn("offset", offset)
    # lines without a number are spread by their pages
    same = F.count("offset").over(Window.partitionBy("doc_id", "offset", F.when(F.col("offset").isNull(), F.hash("page"))))
    w = w.withColumn("r3", F.coalesce("r2", F.when(F.col("offset").isNotNull() & (same >= 2), "page_number")))
    zone = F.col("r3").isNull() & ((F.col("y1") <= REPEAT_TOP * F.col("height")) | (F.col("y0") >= (1 - REPEAT_BOTTOM) * F.col("height")))
    # only what may be boilerplate is counted: texts of four letters or digits, in documents of enough pages
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    zone = zone & (F.col("n_pages") >= REPEAT_PAGES) & (F.length(plain) >= 4)
    w = w.withColumn("key", F.when(zone, F.lower("text"))).withColumn("bucket", F.when(zone, F.floor(F.col("y0") / REPEAT_BUCKET)))
    w = w.withColumn("spread", F.when(F.col("key").isNull(), F.hash("page")).otherwise(0))
    seen = w.filter("key is not null").select("doc_id", "key", "bucket", "page").distinct()
    near = seen.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    counts = near.groupBy("doc_id", "key", "bucket").agg(F.count_distinct("page").alias("on_pages"))
    w = w.join(counts.withColumn("spread", F.lit(0)), ["doc_id", "key", "bucket", "spread"], "left")
    need = F.greatest(F.lit(REPEAT_PAGES), F.ceil(REPEAT_SHARE * F.col("n_pages")))
    alnum = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    w = w.withColumn("r4", F.coalesce("r3", F.when((F.col("n_pages") >= REPEAT_PAGES) & (F.col("on_pages") >= need) & (alnum >= 4), "repeated_boilerplate")))
    override = F.lit(False)
    for p in patterns:
        override = override | F.col("text").rlike(f"^(?:{p})$")
    return w.withColumn("removed", F.coalesce("r4", F.when(override, "override_pattern"))).select(*lines.columns, "removed")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body_size (the half point size of most characters, the first seen of equals), body_bold, line_width (the
    90th percentile by index of the widths of body lines)."""
    half = F.round(F.col("size") * 2) / 2
    by = lines.withColumn("half", half).groupBy("doc_id", "half").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.col("bold_ratio") * F.length("text")).alias("bold"), F.min("seq").alias("seq"))
    body = by.groupBy("doc_id").agg(F.max_by(F.struct("half", "chars", "bold"), F.struct("chars", -F.col("seq"))).alias("b"))
    widths = lines.join(body, "doc_id").filter(F.abs(F.col("size") - F.col("b.half")) <= 0.6).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("x1") - F.col("x0"))).alias("w"))
    at = F.floor((F.size("w") - 1) * 0.9).cast("int") + 1
    return body.join(widths, "doc_id", "left").select("doc_id", F.col("b.half").alias("body_size"), (F.col("b.bold") / F.col("b.chars") > 0.5).alias("body_bold"), F.coalesce(F.element_at("w", at), F.lit(400.0)).alias("line_width"))


def classify(blocks: DataFrame) -> DataFrame:
    """Adds kind and list_type to blocks (text, size, body_size, bold_ratio, body_bold, line_count)."""
    text, marker = F.col("text"), list_marker(F.col("text"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    like = (F.col("line_count") <= HEADING_LINES) & (F.length(text) <= HEADING_CHARS) & (words <= HEADING_WORDS) & ~text.rlike("[.;,]$") & (F.length(F.regexp_replace(text, r"\P{L}", "")) >= 2) & ~F.coalesce(marker == "bullet", F.lit(False))
    large = F.col("size") / F.nullif("body_size", F.lit(0.0)) >= HEADING_RATIO
    bold = (F.col("bold_ratio") >= 0.9) & ~F.col("body_bold") & (F.col("line_count") <= 2) & (F.length(text) <= 120) & ~text.rlike(":$")
    kind = F.when(like & (large | bold), "heading").when(marker.isNotNull(), "list_item").otherwise("paragraph")
    return blocks.withColumn("kind", kind).withColumn("list_type", F.when(F.col("kind") == "list_item", marker))


def runs(df: DataFrame, by: list[str], order: str, state: Column) -> DataFrame:
    """Adds run (a number in each group) and run_length: consecutive rows of the same state are a run."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = (~state.eqNullSafe(F.lag(state).over(w))).cast("long")
    numbered = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w)).drop("_new")
    return numbered.withColumn("run_length", F.count("*").over(Window.partitionBy(*by, "run")).cast("long"))


def demote_heading_runs(blocks: DataFrame) -> DataFrame:
    """Three or more headings of one style in a row are a list: kind becomes list_item, demoted says so."""
    style = F.struct(F.col("kind"), F.round(F.col("size") * 2) / 2, F.col("bold_ratio") >= 0.9)
    w = runs(blocks, ["doc_id"], "seq", style)
    demoted = (F.col("kind") == "heading") & (F.col("run_length") >= 3)
    return w.withColumn("demoted", demoted).withColumn("kind", F.when(demoted, "list_item").otherwise(F.col("kind"))).drop("run", "run_length")


def gaps(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The free space (gap_start, gap_end) between the unions of intervals (start, end) of each group."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("reach", reach).filter(F.col("start") > F.col("reach")).select(*by, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))


def heading_levels(headings: DataFrame, most: int = 6) -> DataFrame:
    """Adds level: the place of a heading's style (size, bold, capitals) among the document's styles, the largest first."""
    w = Window.partitionBy("doc_id").orderBy(F.col("size").desc(), F.col("bold").desc(), F.col("caps").desc())
    return headings.withColumn("level", F.least(F.dense_rank().over(w), F.lit(most)).cast("long"))


def section_parents(headings: DataFrame) -> DataFrame:
    """Adds parent_seq: the last earlier heading of a lower level. One ordered scan of each document's few levels."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    for k in range(1, 7):
        out = out.withColumn(f"_last{k}", F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(w))
    candidates = [F.when(F.col("level") > k, F.col(f"_last{k}")) for k in range(1, 7)]
    return out.withColumn("parent_seq", F.greatest(*candidates)).drop(*(f"_last{k}" for k in range(1, 7)))


def xy_cut(items: DataFrame, strong_gap: float = 12.0, least_column_gap: float = 14.0) -> DataFrame:
    """doc_id, page, item, place: reading order by recursive cuts of each page (doc_id, page, item, x0, y0, x1, y1).

    A page is cut at white bands: first at the horizontal ones that are wide enough, else at vertical ones that part
    columns; what can't be cut is read from top to bottom (to a tenth of a point), then left to right. One group is one page.
    """
    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("item")
        places = reading_order([Box(*b) for b in own[["x0", "y0", "x1", "y1"]].itertuples(index=False)], strong_gap, least_column_gap)
        return pd.DataFrame({"doc_id": own.doc_id.iloc[0], "page": own.page.iloc[0], "item": own.item.to_numpy()[places], "place": range(1, len(places) + 1)})

    return items.groupBy("doc_id", "page").applyInPandas(order, "doc_id string, page long, item long, place long")
