"""Context assembly within budgets, the gate, citations, and the verification of claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import numbers

# Limits of a context, and of the gate.
MOST_SOURCES, MOST_TOKENS, LEAST_SOURCES, LEAST_SCORE, LEAST_QUOTE = 6, 2400, 1, 0.0, 8


def assemble(evidence: DataFrame, most_sources: int = MOST_SOURCES, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """query_id, item_id, rank, label (S1, ... or null), cost, reason (why it was left out) of evidence
    (query_id, item_id, rank, tokens, content_hash).

    In order of rank: an item that is there already is left out; so is one beyond the number of sources, or one that the
    tokens left can't hold, after which smaller ones are still tried. A text that is there already costs nothing.
    """
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, hashes, n, used, rows = set(), set(), 0, 0, []
        for r in pdf.sort_values("rank").itertuples():
            cost = 0 if r.content_hash in hashes else int(r.tokens)
            reason = "repeated chunk" if r.item_id in seen else "source limit" if n >= most_sources else "token budget" if used + cost > most_tokens else None
            if reason is None:
                n, used = n + 1, used + cost
                seen.add(r.item_id)
                hashes.add(r.content_hash)
            rows.append((r.query_id, r.item_id, r.rank, None if reason else f"S{n}", cost, reason))
        return pd.DataFrame(rows, columns=["query_id", "item_id", "rank", "label", "cost", "reason"])

    return evidence.groupBy("query_id").applyInPandas(pick, "query_id long, item_id long, rank long, label string, cost long, reason string")


def version_groups(sources: DataFrame) -> DataFrame:
    """query_id, series_id, doc_id, place (by effective day), labels, for series of two or more documents in a context."""
    per = sources.groupBy("query_id", "series_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ",").alias("labels"), F.min("effective").alias("effective"))
    w = Window.partitionBy("query_id", "series_id")
    return per.filter("series_id is not null").withColumn("n", F.count("*").over(w)).filter("n >= 2").withColumn("place", F.row_number().over(w.orderBy(F.col("effective").asc_nulls_first(), "doc_id")).cast("long")).drop("n", "effective")


def gate(evidence: DataFrame) -> DataFrame:
    """query_id, n, best, passes: enough evidence, and the best score is 0 or more unless there are no scores."""
    g = evidence.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return g.withColumn("passes", (F.col("n") >= LEAST_SOURCES) & (F.col("best").isNull() | (F.col("best") >= LEAST_SCORE)))


def number_citations(uses: DataFrame) -> DataFrame:
    """Adds number to uses (answer_id, claim, position, label): labels by their first use over all claims."""
    first = uses.groupBy("answer_id", "label").agg(F.min(F.struct("claim", "position")).alias("first"))
    w = Window.partitionBy("answer_id").orderBy("first", "label")
    return uses.join(first.withColumn("number", F.row_number().over(w).cast("long")).drop("first"), ["answer_id", "label"])


def occurs_in_order(passages: Column, text: Column) -> Column:
    """Whether all passages are in a text, one after the other without overlap."""
    def after(at: Column, passage: Column) -> Column:
        found = F.call_function("locate", passage, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(passage)).otherwise(0)

    end = F.aggregate(passages, F.lit(1), after)
    return end > 0


def ungrounded_numbers(claim: Column, *allowed: Column) -> Column:
    """Numbers of a claim that none of the allowed texts holds."""
    return F.array_except(numbers(claim), F.array_distinct(F.flatten(F.array(*(numbers(a) for a in allowed)))))


def differing_series(sources: DataFrame) -> DataFrame:
    """query_id, series_id, n_versions, differ of a context's sources (query_id, series_id, doc_id, content_hash): whether the
    versions of a series are there with different sets of texts."""
    per = sources.filter("series_id IS NOT NULL").groupBy("query_id", "series_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("content_hash")), ",").alias("hashes"))
    return per.groupBy("query_id", "series_id").agg(F.count("*").alias("n_versions"), (F.count_distinct("hashes") > 1).alias("differ"))


def eligible(differing: DataFrame, intents: DataFrame) -> DataFrame:
    """query_id, series_id: the one series that a neutral question (query_id, kind) may be split on; none if its versions
    agree, or if there are several such series."""
    one = differing.filter("differ").groupBy("query_id").agg(F.count("*").alias("n"), F.min("series_id").alias("series_id")).filter("n = 1")
    return one.join(intents.filter("kind = 'neutral'").select("query_id"), "query_id", "left_semi").select("query_id", "series_id")


def source_header(label: Column, fields: dict[str, Column]) -> Column:
    """[label] and "name: value" of the fields that are known, between bars."""
    return F.concat_ws(" | ", F.concat(F.lit("["), label, F.lit("]")), *(F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields.items()))


def rendered(sources: DataFrame) -> DataFrame:
    """query_id, text: a context as it is shown, of sources (query_id, rank, label, header, text, duplicate_of)."""
    body = F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("(identical text to ["), "duplicate_of", F.lit("]; not repeated)"))).otherwise(F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", "header", body).alias("block"))))
    return sources.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("text"))


def version_note(groups: DataFrame) -> DataFrame:
    """query_id, note of version_groups() with name (of the document), effective, superseded and is_current: a line for each
    series, and one for each of its versions with the labels that are of it."""
    dates = F.concat(F.lit("effective "), F.coalesce(F.col("effective").cast("string"), F.lit("unknown")), F.coalesce(F.concat(F.lit(", superseded "), F.col("superseded").cast("string")), F.lit("")), F.when(F.col("is_current"), ", current").otherwise(""))
    line = F.concat(F.lit("  - version "), dates, F.lit(": "), F.replace("labels", F.lit(","), F.lit(", ")))
    per = groups.groupBy("query_id", "series_id").agg(F.count("*").alias("n"), F.first("name").alias("name"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("- "), F.coalesce("name", F.col("series_id").cast("string")), F.lit(": "), F.col("n").cast("string"), F.lit(" versions of the same document; rules can differ between them."))
    text = F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    notes = F.array_sort(F.collect_list(F.struct("series_id", text.alias("text"))))
    return per.groupBy("query_id").agg(F.concat(F.lit("Document versions:\n"), F.array_join(F.transform(notes, lambda x: x["text"]), "\n")).alias("note"))
