"""Verdicts on answers: parsed claims, their quotes, numbers and dates against the sources they cite."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.dates import comparison_form, dates_in, quote_passages, unsupported_dates
from docquarry.functions.text import numbers
from docquarry.functions.verdict import Source, judge
from docquarry.operators.context import LEAST_QUOTE, occurs_in_order

ANSWER = "status string, claims array<struct<text: string, sources: array<string>, quotes: array<string>>>, not_in_sources array<string>, abstention_reason string"
# What an answer may be.
STATUSES = ("answered", "partial", "abstained")


def parse(answers: DataFrame) -> DataFrame:
    """Adds a (the parsed body, null where it is none) and problem to answers (answer_id, body)."""
    parsed = answers.withColumn("a", F.from_json("body", ANSWER))
    status = F.col("a.status")
    problem = F.when(F.col("body").isNull() | F.col("a").isNull() | status.isNull(), "not_a_document").when(~status.isin(*STATUSES), "unknown_status").when((status != "abstained") & (F.coalesce(F.size("a.claims"), F.lit(0)) == 0), "no_claims")
    return parsed.withColumn("problem", problem)


def claims_of(parsed: DataFrame) -> DataFrame:
    """answer_id, claim (from 0), text, sources, quotes of the answers that could be parsed."""
    good = parsed.filter("problem is null").select("answer_id", F.posexplode("a.claims").alias("claim", "c"))
    return good.select("answer_id", "claim", "c.text", F.coalesce("c.sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("c.quotes", F.array().cast("array<string>")).alias("quotes"))


def problems(answers: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """answer_id, claim (null: the answer), problem: all that speaks against answers (answer_id, body).

    sources: answer_id, label, text, what was shown for an answer. questions: answer_id, question. A claim must cite a
    source that was shown; each quote must stand in one cited source, in order if it leaves something out, with a passage
    of some length; its numbers and dates must be in its sources or in the question.
    """
    parsed = parse(answers)
    claims = claims_of(parsed)
    own = parsed.filter("problem is not null").select("answer_id", F.lit(None).cast("int").alias("claim"), "problem")
    uncited = claims.filter(F.size("sources") == 0).select("answer_id", "claim", F.lit("no_source").alias("problem"))
    cited = claims.select("answer_id", "claim", F.explode("sources").alias("label")).join(sources, ["answer_id", "label"], "left")
    unknown = cited.filter("text is null").select("answer_id", "claim", F.lit("unknown_source").alias("problem")).distinct()

    quoted = claims.select("answer_id", "claim", F.posexplode("quotes").alias("quote", "q"))
    folded = quoted.select("answer_id", "claim", "quote", quote_passages("q").alias("passages"))
    texts = cited.filter("text is not null").select("answer_id", "claim", comparison_form("text").alias("source"))
    found = folded.join(texts, ["answer_id", "claim"], "left").withColumn("in", F.col("source").isNotNull() & (F.size("passages") > 0) & occurs_in_order(F.col("passages"), F.col("source")))
    per = found.groupBy("answer_id", "claim", "quote").agg(F.max("in").alias("in"), F.first("passages").alias("passages"))
    longest = F.coalesce(F.array_max(F.transform("passages", F.length)), F.lit(0))
    quotes = per.select("answer_id", "claim", F.when(longest < LEAST_QUOTE, "short_quote").when(~F.col("in"), "quote_not_found").alias("problem")).filter("problem is not null").distinct()

    allowed = cited.filter("text is not null").select("answer_id", "claim", "text").unionByName(claims.select("answer_id", "claim").join(questions.select("answer_id", F.col("question").alias("text")), "answer_id"))
    ground = allowed.groupBy("answer_id", "claim").agg(F.concat_ws("\n", F.collect_list("text")).alias("ground"))
    stated = claims.select("answer_id", "claim", "text").join(ground, ["answer_id", "claim"], "left").withColumn("ground", F.coalesce("ground", F.lit("")))
    missing = stated.filter(F.size(F.array_except(numbers(F.col("text")), numbers(F.col("ground")))) > 0).select("answer_id", "claim", F.lit("number_not_in_sources").alias("problem"))
    dated = stated.select("answer_id", "claim", dates_in("text").alias("d"), dates_in("ground").alias("g"))
    undated = dated.filter(F.size(unsupported_dates(F.col("d"), F.col("g"))) > 0).select("answer_id", "claim", F.lit("date_not_in_sources").alias("problem"))
    return reduce(DataFrame.unionByName, [own, uncited, unknown, quotes, missing, undated])


def verdicts(answers: DataFrame, found: DataFrame) -> DataFrame:
    """answer_id, n_problems, accepted: an answer stands if nothing speaks against it."""
    n = found.groupBy("answer_id").agg(F.count("*").alias("n"))
    return answers.select("answer_id").join(n, "answer_id", "left").select("answer_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_problems"), F.col("n").isNull().alias("accepted"))


def judged(answers: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """answer_id, status, accepted, problems and notes (array of claim, code, detail) of answers (answer_id, body).

    sources: answer_id, label, text, meta, doc_id, series_id, effective, superseded: what was shown for an answer, a few for
    each. questions: answer_id, question, asked (a map of series to the documents that the question selected; may be
    null). An answer without sources or question is judged without them. All rules of functions/verdict.py apply.
    """
    shown = sources.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct(*Source._fields))).alias("sources"))
    asked = questions.select("answer_id", "question", "asked")
    rows = answers.select("answer_id", "body").join(shown, "answer_id", "left").join(asked, "answer_id", "left")
    problem = "array<struct<claim: int, code: string, detail: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("claim", pa.int32()), ("code", pa.string()), ("detail", pa.string())]))
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                own = [Source(**{k: v if v is not None or k in ("series_id", "effective", "superseded") else "" for k, v in s.items()}) for s in r["sources"] or []]
                made.append(judge(r["body"], own, r["question"] or "", dict(r["asked"] or [])))
            found = [pa.array([[p._asdict() for p in getattr(v, name)] for v in made], kind) for name in ("problems", "notes")]
            yield pa.RecordBatch.from_arrays([batch.column("answer_id"), pa.array([v.status for v in made], pa.string()), pa.array([v.accepted for v in made], pa.bool_()), *found], names=["answer_id", "status", "accepted", "problems", "notes"])

    return rows.mapInArrow(run, f"answer_id {answers.schema['answer_id'].dataType.simpleString()}, status string, accepted boolean, problems {problem}, notes {problem}")
