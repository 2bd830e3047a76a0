"""Records and metadata: labelled fields, dates of many formats, names, message contracts, and versioned envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import metadata as M
from docquarry.operators.ordered import scan_documents

# Fixed value: the version of stored sessions.
SESSION_VERSION = 1
# How dates are written in documents, and as what they are kept.
DATE_FORMATS = [("MMMM d, yyyy", "yyyy-MM-dd"), ("MMMM d yyyy", "yyyy-MM-dd"), ("yyyy-MM-dd", "yyyy-MM-dd"), ("M/d/yyyy", "yyyy-MM-dd"), ("MMMM, yyyy", "yyyy-MM"), ("MMMM yyyy", "yyyy-MM"), ("M/yyyy", "yyyy-MM")]
# Beside these, ordinal days, short months and days that stand before their month are read.
MORE_FORMATS = [("MMM d, yyyy", "yyyy-MM-dd"), ("d MMMM yyyy", "yyyy-MM-dd"), ("MMM yyyy", "yyyy-MM")]


def normalized_date(text: Column) -> Column:
    """A written date as yyyy-MM-dd, or as yyyy-MM if it names no day; null for anything else. Spaces are single, and a full
    stop at the end does not count."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\.$", "")
    plain = F.initcap(F.regexp_replace(plain, r"(?<=\d)(st|nd|rd|th)\b", ""))
    return F.coalesce(*(F.date_format(F.try_to_timestamp(plain, F.lit(f)), out) for f, out in DATE_FORMATS + MORE_FORMATS))


def labelled_fields(blocks: DataFrame, labels: list[str], most_pages: int = 2) -> DataFrame:
    """doc_id, label, value, page, seq of blocks (doc_id, seq, page, text): "Label: value" in one block, or a label alone
    and the next block. Labels are a fixed vocabulary, without regard to case; the first pages only."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    key = F.lower(F.trim(F.regexp_extract("text", r"^([^:]{1,40}?)\s*:?\s*$", 1)))
    inline = F.regexp_extract("text", r"^([^:]{1,40}?)\s*:\s+(\S.*)$", 1)
    known = [x.lower() for x in labels]
    near = blocks.withColumn("after", F.lead("text").over(w)).filter(F.col("page") <= most_pages)
    found = near.withColumn("label", F.when(F.lower(F.trim(inline)).isin(known), F.lower(F.trim(inline))).when(key.isin(known), key))
    value = F.when(F.lower(F.trim(inline)).isin(known), F.regexp_extract("text", r"^[^:]{1,40}?\s*:\s+(\S.*)$", 1)).otherwise(F.col("after"))
    return found.withColumn("value", F.trim(value)).filter("label is not null and value != ''").select("doc_id", "label", "value", "page", "seq")


def by_priority(candidates: DataFrame) -> DataFrame:
    """doc_id, field, value, source of candidates (doc_id, field, value, source, priority): the first one that is known."""
    w = Window.partitionBy("doc_id", "field").orderBy("priority", "source", "value")
    return candidates.filter("value is not null").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("doc_id", "field", "value", "source")


def resolved_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Adds organization to asked (name): a full name or an alias (name, organization, priority), without regard to case;
    null if it is unknown."""
    w = Window.partitionBy("key").orderBy("priority", "organization")
    known = names.select(F.lower("name").alias("key"), "organization", "priority").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("key", "organization")
    return asked.withColumn("key", F.lower(F.trim("name"))).join(known, "key", "left").drop("key")


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused with a reason) of events (job_id, status, result, error): a result belongs to completed jobs only, an
    error to failed ones only, and each must be there."""
    known = ("queued", "processing", "completed", "failed")
    reason = F.when(F.col("job_id").isNull(), "no_job").when(F.col("status").isNull() | ~F.col("status").isin(*known), "unknown_status").when((F.col("status") == "completed") != F.col("result").isNotNull(), "result").when((F.col("status") == "failed") != F.col("error").isNotNull(), "error")
    judged = events.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def encode_sessions(sessions: DataFrame) -> DataFrame:
    """session_id, body: a JSON envelope of the session (a struct column) with format and version."""
    return sessions.select("session_id", F.to_json(F.struct(F.lit("session").alias("format"), F.lit(SESSION_VERSION).alias("version"), "session")).alias("body"))


def decode_sessions(stored: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(session_id, session; session_id, body of what is of another format or version, which is refused)."""
    read = stored.withColumn("e", F.from_json("body", f"format string, version int, session {schema}"))
    good = F.coalesce((F.col("e.format") == "session") & (F.col("e.version") == SESSION_VERSION) & F.col("e.session").isNotNull(), F.lit(False))
    return read.filter(good).select("session_id", "e.session"), read.filter(~good).select("session_id", "body")


def document_fields(blocks: DataFrame) -> DataFrame:
    """doc_id, field, value, normalized, source, page: what documents say about themselves, of their blocks (doc_id, seq, page,
    kind, text, size, rows; tab_title, pdf_title, web_print where they are known): labelled fields (the first of a name),
    title and organization."""
    def scan(rows: list[dict]) -> list[dict]:
        first = rows[0]
        said = [M.Said(r["page"], r["kind"] or "paragraph", r["text"] or "", r.get("size") or 0.0, tuple(map(tuple, r["rows"])) if r.get("rows") else None) for r in rows]
        out: dict[str, dict] = {}
        for f in M.labelled_fields(said):
            if f.name and f.name != "title":
                out.setdefault(f.name, {"value": f.value, "source": "document_text", "page": f.page})
        title = M.title_of(said, first.get("tab_title"), first.get("pdf_title"), bool(first.get("web_print")))
        if title:
            out["title"] = {"value": title[0], "source": title[1], "page": None}
        organization = M.organization_of(first.get("tab_title"), first.get("pdf_title"))
        if organization:
            out["organization"] = {"value": organization, "source": "browser_title", "page": None}
        return [{"doc_id": first["doc_id"], "field": k, **v} for k, v in out.items()]

    found = scan_documents(blocks.withColumn("doc_id", F.col("doc_id").cast("string")), scan, "doc_id string, field string, value string, source string, page int")
    return found.withColumn("normalized", F.when(F.endswith("field", F.lit("_date")), normalized_date(F.col("value"))))


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused with a reason) of requests (job_id, session_id, question): each must have all three, with text."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    judged = requests.withColumn("reason", F.when(blank("job_id"), "no_job").when(blank("session_id"), "no_session").when(blank("question"), "no_question"))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
