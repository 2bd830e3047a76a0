"""Outlines and chunks of documents whose blocks are rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import outline as O
from docquarry.functions.passages import MOST, chunk_document
from docquarry.operators.ordered import scan_documents

CHUNK = (
    "doc_id string, chunk_id string, ordinal int, section_path array<string>, clause_id string, clause_ids array<string>, pages array<int>, block_ids array<string>, line_ids array<string>, "
    "span array<int>, text string, header string, lead_in string, retrieval_text string, tokens int, retrieval_tokens int, content_hash string, split string, confidence string, "
    "reasons array<string>, retrievable boolean, excluded_as string, prev_id string, next_id string"
)


def block_of(row: dict) -> O.Block:
    """A block of a row; columns that are missing or null have their defaults."""
    given = {k: row[k] for k in O.Block._fields if row.get(k) is not None}
    if "rows" in given:
        given["rows"] = tuple(map(tuple, given["rows"]))
    if "lines" in given:
        given["lines"] = tuple((x["line_id"], x["text"]) for x in given["lines"])
    given["flags"] = tuple(given.get("flags", ()))
    return O.Block(**{"block_id": str(row["seq"]), "kind": "paragraph", "text": "", **given})


def chunk_documents(blocks: DataFrame) -> DataFrame:
    """Chunks and excluded records of blocks (doc_id, seq, kind, text, and any of the fields of a block; title and
    organization of the document, if known): clauses are kept whole, small neighbours are merged, large ones are cut."""
    def scan(rows: list[dict]) -> list[dict]:
        first = rows[0]
        chunks, _ = chunk_document(first["doc_id"], [block_of(r) for r in rows], first.get("title"), first.get("organization"))
        return chunks

    return scan_documents(blocks.withColumn("doc_id", F.col("doc_id").cast("string")), scan, CHUNK)


def chunk_diagnostics(blocks: DataFrame) -> DataFrame:
    """doc_id, code, block_id, message: what is doubtful about documents and their chunks."""
    def scan(rows: list[dict]) -> list[dict]:
        _, notes = chunk_document(rows[0]["doc_id"], [block_of(r) for r in rows], rows[0].get("title"), rows[0].get("organization"))
        return [{"doc_id": rows[0]["doc_id"], **n} for n in notes]

    return scan_documents(blocks.withColumn("doc_id", F.col("doc_id").cast("string")), scan, "doc_id string, code string, block_id string, message string")


def _places(blocks: DataFrame, chosen: Callable[[list[O.Block]], set[int]]) -> DataFrame:
    kind = blocks.schema["doc_id"].dataType.simpleString()
    return scan_documents(blocks, lambda rows: [{"doc_id": rows[i]["doc_id"], "seq": rows[i]["seq"]} for i in sorted(chosen([block_of(r) for r in rows]))], f"doc_id {kind}, seq long")


def navigation_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, seq of blocks that repeat later headings in runs."""
    return _places(blocks, lambda own: O.navigation(own, list(range(len(own)))))


def grid_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, seq of blocks that look like the cells of a table without borders."""
    return _places(blocks, O.grid_places)


def foreign_number_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, seq of numbers of several levels that nothing else in the document is related to."""
    return _places(blocks, O.foreign_numbers)


def hidden_heading_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, seq of paragraphs that are headings of numbered sections."""
    return _places(blocks, lambda own: set(O.hidden_headings(own)))


def outline_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, seq, path, clause (the nearest number): where each block stands."""
    def scan(rows: list[dict]) -> list[dict]:
        made = O.outline([block_of(r) for r in rows])
        return [{"doc_id": rows[i]["doc_id"], "seq": rows[i]["seq"], "path": p.path(), "clause": n.number.label if (n := p.numbered()) else None} for i, p in sorted(made.owner.items())]

    return scan_documents(blocks, scan, f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, seq long, path array<string>, clause string")


def implied_number(title: Column) -> Column:
    """The number that a title implies for its clauses, or null."""
    return F.nullif(F.regexp_extract(title, r"\b(?:Standard|Section|Chapter|Article|Part)\s+(\d{1,3})\b", 1), F.lit(""))


def list_continuations(blocks: DataFrame) -> DataFrame:
    """Headings (doc_id, seq, kind, marker, x) whose letter is the next one of the list item before them, at its indent."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.struct("kind", "marker", "x")
    letter = lambda c: F.regexp_extract(c, r"^\(?([a-z])[.)]$", 1)
    seen = blocks.withColumn("b", F.lag(before).over(w))
    follows = (letter(F.col("b.marker")) != "") & (letter("marker") != "") & (F.ascii(letter("marker")) == F.ascii(letter(F.col("b.marker"))) + 1)
    return seen.filter((F.col("kind") == "heading") & (F.col("b.kind") == "list_item") & follows & (F.abs(F.col("x") - F.col("b.x")) <= 3)).drop("b")


def coverage_problems(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """code, id: chunk ids that collide, blocks (block_id) that no chunk (chunk_id, block_ids, retrieval_tokens) holds, and
    chunks that are too large."""
    twice = chunks.groupBy("chunk_id").count().filter("count > 1").select(F.lit("duplicate_chunk_id").alias("code"), F.col("chunk_id").alias("id"))
    held = chunks.select(F.explode("block_ids").alias("block_id"))
    missing = blocks.select("block_id").join(held, "block_id", "left_anti").select(F.lit("block_not_chunked").alias("code"), F.col("block_id").alias("id"))
    large = chunks.filter(F.col("retrieval_tokens") > MOST).select(F.lit("oversized_chunk").alias("code"), F.col("chunk_id").alias("id"))
    return twice.unionByName(missing).unionByName(large)
