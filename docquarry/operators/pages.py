"""Pages whose pieces, lines and tables are rows: lines, blocks, sections and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import blocks as B
from docquarry.operators.ordered import scan_documents

LINE = "doc_id string, page int, line_id string, text string, x0 double, y0 double, x1 double, y1 double, size double, bold double, font string, removed string, repairs map<string, int>"
BLOCK = (
    "doc_id string, seq int, page int, block_id string, kind string, list_type string, marker string, number string, text string, x double, y double, size double, bold double, level int, "
    "section_id string, section_path array<string>, flags array<string>, confidence string, retrievable boolean, rows array<array<string>>, line_ids array<string>"
)


def profile(producer: Column, creator: Column, override: Column | None = None) -> Column:
    """web_print, office_export or generic, by what made a file; an override wins."""
    made, by = F.lower(F.coalesce(producer, F.lit(""))), F.lower(F.coalesce(creator, F.lit("")))
    found = F.when(F.startswith(made, F.lit("skia/pdf")) & F.contains(by, F.lit("mozilla")), "web_print").when(by.rlike("word|pdfmaker") | F.contains(made, F.lit("word")), "office_export").otherwise("generic")
    return found if override is None else F.coalesce(override, found)


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | F.lower(font).rlike("|".join(B.BOLD_NAMES))


def lines_of_pages(spans: DataFrame) -> DataFrame:
    """Lines of spans (doc_id, page, piece, span, x0 ... y1 of the piece, font, size, flags, chars: array of c and w).

    Lost ligatures come back, pieces that are drawn twice are marked duplicate_render, and pieces of one visual line are
    joined. One page is one group.
    """
    def scan(rows: list[dict]) -> list[dict]:
        out = []
        pages: dict[int, dict[int, list[dict]]] = {}
        for r in rows:
            pages.setdefault(r["page"], {}).setdefault(r["piece"], []).append(r)
        for page, pieces in pages.items():
            glyphs = {k: [B.Glyphs(r["font"], r["size"], r["flags"], tuple((c["c"], c["w"]) for c in r["chars"])) for r in own] for k, own in pieces.items()}
            wide = B.wide_letters([g for own in glyphs.values() for g in own])
            made = [B.piece_of(B.Box(*(pieces[k][0][c] for c in ("x0", "y0", "x1", "y1"))), own, wide) for k, own in glyphs.items()]
            kept, again = B.split_duplicates([p for p in made if p])
            every = [(p, None) for p in B.visual_lines(kept)] + [(p, "duplicate_render") for p in again]
            for i, (p, removed) in enumerate(every):
                x = B.line_of(p, page, i, removed)
                out.append({"doc_id": rows[0]["doc_id"], "page": page, "line_id": x.line_id, "text": x.text, **x.box._asdict(), "size": x.size, "bold": x.bold, "font": x.font, "removed": removed, "repairs": p.repairs})
        return out

    return scan_documents(spans.withColumn("doc_id", F.col("doc_id").cast("string")), scan, LINE, order=("page", "piece", "span"))


def blocks_of_documents(lines: DataFrame) -> DataFrame:
    """Blocks of lines (doc_id, page, line_id, text, x0, y0, x1, y1, size, bold, font, removed; body_size, body_bold,
    line_width of the document; page_width, page_height; title, web_print, excluded: array of title and reason)."""
    def scan(rows: list[dict]) -> list[dict]:
        first = rows[0]
        pages: dict[int, list[dict]] = {}
        for r in rows:
            pages.setdefault(r["page"], []).append(r)
        made = [(page, own[0]["page_width"], own[0]["page_height"], [B.Line(r["line_id"], r["text"], B.Box(r["x0"], r["y0"], r["x1"], r["y1"]), r["size"], r["bold"], r["font"] or "", r["removed"], page) for r in own], []) for page, own in pages.items()]
        style = B.Style(first["body_size"], first["body_bold"], first["line_width"])
        blocks, sections, _ = B.blocks_of_pages(made, style, first.get("title"), bool(first.get("web_print")), [(x["title"], x["reason"]) for x in first.get("excluded") or []])
        return [
            {
                "doc_id": first["doc_id"], "seq": i, "page": b.page, "block_id": b.block_id, "kind": b.kind, "list_type": b.list_type, "marker": b.marker, "number": b.number, "text": b.text,
                "x": b.box.x0, "y": b.box.y0, "size": b.size, "bold": b.bold, "level": b.level, "section_id": None if b.section is None else f"s{b.section}", "section_path": B.section_path(sections, b.section),
                "flags": b.flags, "confidence": b.confidence, "retrievable": B.is_retrievable(b), "rows": b.rows, "line_ids": [x.line_id for x in b.lines],
            }
            for i, b in enumerate(blocks)
        ]

    return scan_documents(lines.withColumn("doc_id", F.col("doc_id").cast("string")), scan, BLOCK, order=("page", "line_id"))


def retrievable(flags: Column) -> Column:
    """Whether no flag says that a block is site chrome or excluded."""
    return ~F.exists(flags, lambda f: F.startswith(f, F.lit("suspected_chrome")) | F.startswith(f, F.lit("exclude_from_retrieval")))


def section_paths(sections: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, section_id, path of sections (doc_id, section_id, parent_id, title): titles from the outermost one. There
    are at most six levels, so that as many joins reach the top."""
    out = sections.select("doc_id", "section_id", F.array("title").alias("path"), F.col("parent_id").alias("next"))
    up = sections.select("doc_id", F.col("section_id").alias("next"), F.col("title").alias("above"), F.col("parent_id").alias("then"))
    for _ in range(most - 1):
        out = out.join(up, ["doc_id", "next"], "left").select("doc_id", "section_id", F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat(F.array("above"), "path")).alias("path"), F.col("then").alias("next"))
    return out.select("doc_id", "section_id", "path")


def excluded_by_section(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds excluded_as to blocks (doc_id, path): the reason of a rule (doc_id, title, reason) whose title is in the path."""
    names = F.transform("path", lambda t: F.lower(F.trim(t)))
    exploded = blocks.select("doc_id", "block_id", F.explode(names).alias("title"))
    found = exploded.join(rules.select("doc_id", F.lower(F.trim("title")).alias("title"), "reason"), ["doc_id", "title"]).groupBy("doc_id", "block_id").agg(F.min("reason").alias("excluded_as"))
    return blocks.join(found, ["doc_id", "block_id"], "left")


def weighted(lines: DataFrame, value: str) -> DataFrame:
    """doc_id, block: the union of boxes and the mean of a value by the lengths of texts, of lines (doc_id, block)."""
    length = F.length("text")
    mean = F.round(F.sum(F.col(value) * length) / F.greatest(F.sum(length), F.lit(1)), 2)
    return lines.groupBy("doc_id", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), mean.alias(value))


def implicit_list_runs(blocks: DataFrame) -> DataFrame:
    """Adds listed: whether a short line (doc_id, seq, kind, text, line_count, x) is one of three or more in a row at one
    indent."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    short = (F.col("kind") == "paragraph") & (F.col("line_count") == 1) & (words <= 10) & ~F.endswith("text", F.lit("."))
    state = F.struct(short.alias("short"), F.when(short, F.round(F.col("x") / 2)).alias("x"))
    marked = blocks.withColumn("_s", state).withColumn("_new", (~F.col("_s").eqNullSafe(F.lag("_s").over(w))).cast("long")).withColumn("_run", F.sum("_new").over(w))
    n = F.count("*").over(Window.partitionBy("doc_id", "_run"))
    return marked.withColumn("listed", F.col("_s.short") & (n >= 3)).drop("_s", "_new", "_run")


def document_warnings(pages: DataFrame, near_empty: int = 40) -> DataFrame:
    """doc_id, page, code of pages (doc_id, page, raw_text, image_count, kept: the text of its blocks): no_text_layer,
    blank_page, empty_after_cleaning or near_empty_page."""
    raw, kept = F.trim(F.coalesce("raw_text", F.lit(""))), F.coalesce("kept", F.lit(""))
    code = F.when(raw == "", F.when(F.col("image_count") > 0, "no_text_layer").otherwise("blank_page")).when(F.trim(kept) == "", "empty_after_cleaning").when(F.length(kept) < near_empty, "near_empty_page")
    return pages.select("doc_id", "page", code.alias("code")).filter("code IS NOT NULL")


def document_hashes(blocks: DataFrame) -> DataFrame:
    """doc_id, content_hash, blocks and counts by kind, and lists (runs of list items) of blocks (doc_id, seq, kind, text)."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    begins = (F.col("kind") == "list_item") & ~F.lag("kind").over(w).eqNullSafe("list_item")
    seen = blocks.withColumn("_begins", begins)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("heading", "paragraph", "list_item", "table")]
    return seen.groupBy("doc_id").agg(F.sha2(text, 256).alias("content_hash"), F.count("*").alias("n_blocks"), *kinds, F.count_if("_begins").alias("n_lists"), F.sum(F.length("text")).alias("chars"))


def removal_counts(lines: DataFrame) -> DataFrame:
    """doc_id, removed, n of cleaned lines (doc_id, removed): how many went for each reason."""
    return lines.filter("removed IS NOT NULL").groupBy("doc_id", "removed").agg(F.count("*").alias("n"))


def repair_warnings(lines: DataFrame) -> DataFrame:
    """doc_id, code, n of lines (doc_id, repairs: a map of counts, notes: an array, removed): text_repaired, duplicate_render
    and icon_glyphs, as far as they are there."""
    repaired = F.aggregate(F.map_values(F.coalesce("repairs", F.create_map().cast("map<string, int>"))), F.lit(0), lambda a, x: a + x)
    counts = {"text_repaired": F.sum(repaired), "duplicate_render": F.count_if(F.col("removed") == "duplicate_render"), "icon_glyphs": F.count_if(F.array_contains(F.coalesce("notes", F.array().cast("array<string>")), "private_use_glyphs_removed"))}
    codes = F.explode(F.array(*(F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in ((c, F.col(c)) for c in counts)))).alias("c")
    return lines.groupBy("doc_id").agg(*(v.alias(k) for k, v in counts.items())).select("doc_id", codes).select("doc_id", "c.code", "c.n").filter("n > 0")


def document_stats(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Counters of documents: those of document_hashes(), sections, flagged and excluded blocks, lines and lines kept."""
    flagged = F.exists("flags", lambda f: F.startswith(f, F.lit("suspected_chrome")))
    more = blocks.groupBy("doc_id").agg(F.count_distinct("section_id").alias("sections"), F.count_if(flagged).alias("chrome_flagged"), F.count_if(~retrievable(F.col("flags"))).alias("excluded"))
    of_lines = lines.groupBy("doc_id").agg(F.count("*").alias("lines_total"), F.count_if(F.col("removed").isNull()).alias("lines_kept"))
    return document_hashes(blocks).join(more, "doc_id").join(of_lines, "doc_id", "left")
