"""Versions with validity intervals [effective, superseded), and rankings that are filtered by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry(versions: DataFrame) -> DataFrame:
    """Versions (doc_id, series_id, effective, superseded, is_current) of series of at least two documents, with their
    place by (effective, doc_id). A document without a series is none; one that is there twice counts once."""
    once = versions.filter("series_id is not null").dropDuplicates(["doc_id"])
    return once.withColumn("n", F.count("*").over(Window.partitionBy("series_id"))).filter("n >= 2").withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("effective").asc_nulls_first(), "doc_id")).cast("long")).drop("n")


def covers(day: Column, effective: Column = None, superseded: Column = None) -> Column:
    """Whether a version is in force on a day; the day it is superseded is no more one of them."""
    effective, superseded = effective if effective is not None else F.col("effective"), superseded if superseded is not None else F.col("superseded")
    return (effective <= day) & (superseded.isNull() | (day < superseded))


def in_force(versions: DataFrame, days: DataFrame) -> DataFrame:
    """series_id, day, doc_id of the versions that are in force on each of some stated days (day)."""
    return versions.join(F.broadcast(days), covers(F.col("day"))).select("series_id", "day", "doc_id")


def for_month(versions: DataFrame, months: DataFrame) -> DataFrame:
    """series_id, year, month, doc_id: the versions that a month names by their effective date, else those in force on
    its first day. months: year, month (a few)."""
    asked = F.broadcast(months)
    named = versions.join(asked, (F.year("effective") == F.col("year")) & (F.month("effective") == F.col("month"))).select("series_id", "year", "month", "doc_id")
    first_day = F.make_date("year", "month", F.lit(1))
    force = versions.join(asked, covers(first_day)).select("series_id", "year", "month", "doc_id")
    return named.unionByName(force.join(named.select("series_id", "year", "month").distinct(), ["series_id", "year", "month"], "left_anti"))


def current(versions: DataFrame) -> DataFrame:
    """series_id, doc_id (null unless exactly one version is current), n_current. Unknown is not current."""
    g = versions.groupBy("series_id").agg(F.count_if(F.col("is_current")).alias("n_current"), F.max(F.when(F.col("is_current"), F.col("doc_id"))).alias("only"))
    return g.select("series_id", F.when(F.col("n_current") == 1, F.col("only")).alias("doc_id"), "n_current")


def stable_filter(ranking: DataFrame, versions: DataFrame, selected: DataFrame) -> DataFrame:
    """A ranking (query_id, item_id, doc_id, rank) without the documents of versioned series that are not selected, ranked
    anew in the same order. A series of which nothing is selected loses all its documents."""
    dropped = versions.select("doc_id").distinct().join(selected.select("doc_id").distinct(), "doc_id", "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    return ranking.join(dropped, "doc_id", "left_anti").withColumn("kept_rank", F.row_number().over(order).cast("long"))


def applicability(day: Column) -> Column:
    """in_force, not_in_force or undetermined: without an effective day nothing can be said."""
    return F.when(F.col("effective").isNull(), "undetermined").when(covers(day), "in_force").otherwise("not_in_force")


def select(versions: DataFrame, intents: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What questions select of series: (query_id, series_id, doc_ids; query_id, flag).

    versions: a registry (one row a document). asked: query_id, series_id: the series that are looked at for each
    question, such as those in its ranking (series_in()). intents: query_id, kind, dates (array of year, month, day) as
    dates.temporal_intent() gives them. A date selects the version that is in force on its day; a month the versions that
    it names by their effective date, else the one in force on its first day. No version for any date: an empty
    selection, which removes the whole series, and requested_version_unavailable. A question for what is current selects
    the only version that is; else nothing is selected, with current_version_ambiguous. A neutral question selects nothing.
    """
    series = versions.groupBy("series_id").agg(F.collect_list(F.struct("doc_id", "effective", "superseded", "is_current")).alias("vs"))
    asked = asked.distinct().join(intents.filter("kind != 'neutral'"), "query_id").join(series, "series_id")

    def of_date(d: Column) -> Column:
        first = F.try_to_date(F.format_string("%04d-%02d-%02d", d["year"], d["month"], F.coalesce(d["day"], F.lit(1))), "yyyy-MM-dd")
        named = F.filter("vs", lambda v: d["day"].isNull() & (F.year(v["effective"]) == d["year"]) & (F.month(v["effective"]) == d["month"]))
        force = F.filter("vs", lambda v: F.coalesce(covers(first, v["effective"], v["superseded"]), F.lit(False)))
        return F.transform(F.when(F.size(named) > 0, named).otherwise(force), lambda v: v["doc_id"])

    dated = F.array_sort(F.array_distinct(F.flatten(F.transform("dates", of_date))))
    now = F.transform(F.filter("vs", lambda v: F.coalesce(v["is_current"], F.lit(False))), lambda v: v["doc_id"])
    is_now = F.col("kind") == "current"
    chosen = asked.withColumn("doc_ids", F.when(is_now, F.when(F.size(now) == 1, now)).otherwise(dated))
    flag = F.when(is_now & F.col("doc_ids").isNull(), F.concat(F.lit("current_version_ambiguous:"), "series_id")).when(~is_now & (F.size("doc_ids") == 0), F.concat(F.lit("requested_version_unavailable:"), "series_id"))
    return chosen.filter("doc_ids IS NOT NULL").select("query_id", "series_id", "doc_ids"), chosen.select("query_id", flag.alias("flag")).filter("flag IS NOT NULL")


def series_in(ranking: DataFrame, versions: DataFrame) -> DataFrame:
    """query_id, series_id of the series that a ranking (query_id, doc_id) holds documents of."""
    return ranking.select("query_id", "doc_id").join(versions.select("doc_id", "series_id"), "doc_id").select("query_id", "series_id").distinct()


def resolve(ranking: DataFrame, versions: DataFrame, selected: DataFrame) -> DataFrame:
    """A ranking (query_id, item_id, doc_id, rank) without what each question's selection (query_id, series_id, doc_ids)
    leaves out of a series; order and ranks stay, kept_rank numbers what is left."""
    of = versions.select("doc_id", "series_id").dropDuplicates(["doc_id"])
    known = ranking.join(of, "doc_id", "left").join(selected, ["query_id", "series_id"], "left")
    w = Window.partitionBy("query_id").orderBy("rank")
    kept = known.filter(F.col("doc_ids").isNull() | F.array_contains("doc_ids", F.col("doc_id")))
    return kept.select(*ranking.columns, F.row_number().over(w).cast("long").alias("kept_rank"))


def pipelines(hybrid: DataFrame, versions: DataFrame, selected: DataFrame, rerank: Callable[[DataFrame], DataFrame], k: int = 10) -> dict[str, DataFrame]:
    """The four compositions over a fused ranking (query_id, item_id, doc_id, rank): hybrid, hybrid_temporal, rerank and
    temporal_rerank. Versions are resolved before a pool is cut; rerank cuts and scores it."""
    resolved = resolve(hybrid, versions, selected).drop("rank").withColumnRenamed("kept_rank", "rank")
    made = {"hybrid": hybrid, "hybrid_temporal": resolved, "rerank": rerank(hybrid), "temporal_rerank": rerank(resolved)}
    return {name: df.filter(F.col("rank") <= k) for name, df in made.items()}
