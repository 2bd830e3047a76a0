"""Metadata queries with bound parameters, search filters, and snapshots of a corpus."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ROWS, DEFAULT_ROWS = 500, 50

#: name: (parameters, statement). There is no other way to ask: text of a caller never becomes SQL.
NAMED = {
    "documents": (
        ("organization", "domain", "kind", "is_current"),
        "SELECT * FROM {documents} WHERE (:organization IS NULL OR organization = :organization) AND (:domain IS NULL OR domain = :domain) AND (:kind IS NULL OR kind = :kind) AND (:is_current IS NULL OR is_current = :is_current) ORDER BY doc_id",
    ),
    "document_versions": (("series_id",), "SELECT doc_id, series_id, effective FROM {versions} WHERE series_id = :series_id ORDER BY effective ASC NULLS LAST, doc_id"),
    "chunks_by_document": (("doc_id",), "SELECT chunk_id, doc_id, ordinal FROM {chunks} WHERE doc_id = :doc_id ORDER BY ordinal, chunk_id"),
}


def named_query(spark: SparkSession, name: str, tables: dict[str, DataFrame], parameters: dict[str, Any], limit: int = DEFAULT_ROWS) -> tuple[DataFrame, bool]:
    """(rows, whether there were more). Unknown names, parameters and limits are refused."""
    if name not in NAMED:
        raise ValueError(f"no such query: {name}")
    known, statement = NAMED[name]
    if unknown := set(parameters) - set(known):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    if name == "documents":  # columns that a catalog does not have are unknown
        documents = tables["documents"]
        columns = documents.columns
        typed = documents.withColumns({c: F.lit(None).cast("boolean" if c == "is_current" else "string") for c in known if c not in columns})
        every = spark.sql(statement, args={k: parameters.get(k) for k in known}, documents=typed).select(*columns).limit(limit + 1)
    else:
        every = spark.sql(statement, args={k: parameters.get(k) for k in known}, **tables).limit(limit + 1)
    return every.limit(limit), every.count() > limit


def search_filters(ranking: DataFrame, condition, limit: int) -> DataFrame:
    """A ranking that was cut before, filtered and ranked anew: a filter never widens the search."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranking.filter(condition).withColumn("shown", F.row_number().over(w).cast("long")).filter(F.col("shown") <= limit)


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status (unchanged, modified, added or missing) of two snapshots (path, hash)."""
    b, a = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return b.join(a, "path", "full_outer").select("path", status.alias("status"))


def chosen_values(chunks: DataFrame, manifest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A document's values from its chunks if it has any, null ones included, else from the manifest."""
    c = chunks.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(x).alias(f"_{x}") for x in columns))
    both = manifest.join(c, key, "full_outer")
    return both.select(key, *(F.when(F.col("_n") > 0, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in columns), F.coalesce("_n", F.lit(0)).alias("chunk_count"))


# tools

MOST_RESULTS = 20
#: Parameters of each tool: name -> (kind, required); and those of which at most one may be given.
TOOLS = {
    "document_search": ({"query": (str, True), "organization": (str, False), "doc_id": (str, False), "current_only": (bool, False), "as_of": (str, False), "limit": (int, False)}, []),
    "metadata_lookup": ({"chunk_id": (str, False), "doc_id": (str, False), "organization": (str, False), "series_id": (str, False), "domain": (str, False), "kind": (str, False), "current_only": (bool, False)}, [("chunk_id", "doc_id"), ("chunk_id", "organization"), ("chunk_id", "series_id"), ("chunk_id", "domain"), ("chunk_id", "kind"), ("chunk_id", "current_only")]),
    "metadata_query": ({"name": (str, True), "parameters": (dict, False), "limit": (int, False)}, []),
}


def checked_input(tool: str, given: dict[str, Any]) -> dict[str, Any]:
    """A tool's parameters, as they may be used: known, of their kinds, not empty, within limits, and not contradictory."""
    if tool not in TOOLS:
        raise ValueError(f"no such tool: {tool}")
    known, exclusive = TOOLS[tool]
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    for name, (kind, required) in known.items():
        value = given.get(name)
        if value is None and required:
            raise ValueError(f"{name} is required")
        if value is not None and (not isinstance(value, kind) or (kind is int and isinstance(value, bool)) or value == ""):
            raise ValueError(f"{name} must be a {kind.__name__} that is not empty")
    for a, b in exclusive:
        if given.get(a) is not None and given.get(b):
            raise ValueError(f"{a} and {b} exclude each other")
    most = MOST_RESULTS if tool == "document_search" else MOST_ROWS
    if given.get("limit") is not None and not 1 <= given["limit"] <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if given.get("as_of"):
        import datetime

        datetime.date.fromisoformat(given["as_of"])
    return {k: v for k, v in given.items() if v is not None}


def applicability(day, in_series: Column = None, in_force: Column = None) -> Column:
    """in_force, not_in_force or undetermined on a day, of documents (effective_date, superseded_date as text).

    A version of a series of several documents goes by in_force (whether it is then). Another document goes by its full
    ISO dates: one that begins later, or that has been superseded, is not in force; without a full date nothing is known.
    """
    iso = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c).try_cast("date"))
    day = day if isinstance(day, Column) else F.lit(day).cast("date")
    alone = F.when(F.coalesce(iso("effective_date") > day, F.lit(False)) | F.coalesce(iso("superseded_date") <= day, F.lit(False)), "not_in_force").when(iso("effective_date").isNotNull(), "in_force").otherwise("undetermined")
    if in_series is None:
        return alone
    return F.when(in_series, F.when(in_force, "in_force").otherwise("not_in_force")).otherwise(alone)


def document_search(ranking: DataFrame, organization: str | None = None, doc_id: str | None = None, current_only: bool = False, as_of: str | None = None, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(results, notes) of a ranking of at most MOST_RESULTS (query_id, rank, chunk_id, doc_id, organization, is_current,
    effective_date, superseded_date; in_series and in_force where they are known).

    Filters choose among what was retrieved: unknown values stay, except for an organization or a document. Results are
    numbered anew (shown) and say whether they apply on the day (applies). Notes: a query of which nothing is left, and
    documents of which nothing is known about the day.
    """
    pool = ranking.filter(F.col("rank") <= MOST_RESULTS)
    applies = F.lit(None).cast("string")
    if as_of:
        both = {"in_series", "in_force"} <= set(ranking.columns)
        applies = applicability(as_of, *((F.coalesce("in_series", F.lit(False)), F.coalesce("in_force", F.lit(False))) if both else ()))
    keep = F.lit(True)
    if organization is not None:
        keep = keep & (F.col("organization") == organization)
    if doc_id is not None:
        keep = keep & (F.col("doc_id") == doc_id)
    if current_only:
        keep = keep & ~F.col("is_current").eqNullSafe(False)
    if as_of:
        keep = keep & (F.col("applies") != "not_in_force")
    results = search_filters(pool.withColumn("applies", applies), keep, limit)
    counts = pool.groupBy("query_id").agg(F.count("*").alias("n")).join(results.groupBy("query_id").agg(F.count("*").alias("kept")), "query_id", "left")
    empty = counts.filter("kept IS NULL").select("query_id", F.format_string("no retrieved chunk matched the filters among the %d candidates", "n").alias("note"))
    doubtful = results.filter("applies = 'undetermined'").groupBy("query_id").agg(F.concat(F.lit("applicability is undetermined: "), F.array_join(F.array_sort(F.collect_set("doc_id")), ", ")).alias("note"))
    return results, empty.unionByName(doubtful)


def metadata_lookup(documents: DataFrame, current_only: bool = False, **filters: str) -> DataFrame:
    """Documents that match every filter (a column and its value), by id; current_only leaves out what is known not to be."""
    out = documents
    for column, value in filters.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return (out.filter(~F.col("is_current").eqNullSafe(False)) if current_only else out).orderBy("doc_id")


def document_records(manifest: DataFrame, chunks: DataFrame, excluded: DataFrame, versions: DataFrame) -> DataFrame:
    """One record a document: its values as chosen_values() takes them (title, organization, series_id, is_current), how many
    chunks and excluded records it has, and the documents of its series, oldest first (none for a series of one)."""
    columns = [c for c in ("title", "organization", "series_id", "is_current") if c in manifest.columns]
    chosen = chosen_values(chunks, manifest.select("doc_id", *columns), "doc_id", columns)
    gone = excluded.groupBy("doc_id").agg(F.count("*").alias("excluded_records"))
    series = versions.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("effective", "doc_id"))), lambda x: x["doc_id"]).alias("series_versions"))
    out = chosen.join(gone, "doc_id", "left").join(series, "series_id", "left")
    return out.withColumn("excluded_records", F.coalesce("excluded_records", F.lit(0))).withColumn("series_versions", F.coalesce("series_versions", F.array().cast(series.schema["series_versions"].dataType)))


def corpus_info(documents: DataFrame, by: str) -> DataFrame:
    """value, documents: how many documents there are of each value of a column (of an organization, or a series)."""
    return documents.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("documents"))


def the_one(documents: DataFrame, text: str, column: str = "doc_id") -> str:
    """The only id that begins with a text, or else that holds it; an error if there is none, or several."""
    for fits in (F.startswith(column, F.lit(text)), F.contains(F.col(column), F.lit(text))):
        found = [r[0] for r in documents.filter(fits).select(column).distinct().limit(2).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"{text!r} names more than one document")
    raise ValueError(f"{text!r} names no document")


def page_sample(pages: DataFrame) -> DataFrame:
    """The first, middle and last page that has content, of pages (doc_id, page, text)."""
    full = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    w = Window.partitionBy("doc_id")
    seen = full.withColumn("_k", F.row_number().over(w.orderBy("page"))).withColumn("_n", F.count("*").over(w))
    return seen.filter(F.col("_k").isin(1) | (F.col("_k") == F.floor(F.col("_n") / 2) + 1) | (F.col("_k") == F.col("_n"))).drop("_k", "_n")


# telemetry

#: Characters of a text that an attribute may hold.
ATTRIBUTE_TEXT = 256


def safe_attributes(spans: DataFrame, allowed: list[str]) -> DataFrame:
    """Spans (attributes: a map of texts) with the attributes of the allowed names only, cut to ATTRIBUTE_TEXT; nulls go."""
    kept = F.map_filter("attributes", lambda k, v: k.isin(allowed) & v.isNotNull())
    return spans.withColumn("attributes", F.transform_values(kept, lambda k, v: F.substring(v, 1, ATTRIBUTE_TEXT)))


def correlation_id(job_id: Column, request_id: Column) -> Column:
    """The id by which spans of one question are found: its job's, else its request's."""
    return F.coalesce(job_id, request_id)


def round_attributes(rounds: DataFrame) -> DataFrame:
    """query_id, round and sizes of a round's lists (retrieved, new, dropped, kept, context, promoted: arrays)."""
    sizes = [F.size(c).alias(f"n_{c}") for c in ("retrieved", "new", "dropped", "kept", "context", "promoted") if c in rounds.columns]
    return rounds.select("query_id", "round", *sizes, *(c for c in ("strategy", "decision") if c in rounds.columns))
