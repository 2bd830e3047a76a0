"""Retrieval metrics and agreement of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.contained import contained

# Cut-offs of the metrics.
CUTS = (1, 3, 5, 10)


def unit_ranks(gold: DataFrame, ranking: DataFrame) -> DataFrame:
    """case_id, unit, rank: the best rank of any accepted item (case_id, unit, item_id), null if none was retrieved."""
    return gold.join(ranking, ["case_id", "item_id"], "left").groupBy("case_id", "unit").agg(F.min("rank").alias("rank"))


def case_metrics(ranks: DataFrame) -> DataFrame:
    """case_id, recall_1 ... (share of units), all_1 ... (every unit), mrr_10."""
    within = {k: F.coalesce(F.col("rank") <= k, F.lit(False)) for k in CUTS}
    return ranks.groupBy("case_id").agg(*(F.round(F.avg(w.cast("double")), 6).alias(f"recall_{k}") for k, w in within.items()), *(F.every(w).alias(f"all_{k}") for k, w in within.items()), F.round(F.coalesce(1.0 / F.min(F.when(F.col("rank") <= 10, F.col("rank"))), F.lit(0.0)), 6).alias("mrr_10"))


def by_type(metrics: DataFrame, types: DataFrame, columns: list[str]) -> DataFrame:
    """type (null: all cases), n and unweighted means of metrics; a case may be of several types."""
    means = [F.round(F.avg(c), 4).alias(c) for c in columns]
    each = metrics.join(types, "case_id").groupBy("type").agg(F.count("*").alias("n"), *means)
    return metrics.agg(F.count("*").alias("n"), *means).select(F.lit(None).cast("string").alias("type"), "n", *columns).unionByName(each)


def agreement(runs: DataFrame, facets: tuple[str, ...] = ("value",)) -> DataFrame:
    """case_id, n_runs, and same (or same_<facet> for each facet): whether all runs (case_id, run, facets as text) gave the
    same. What is compared are texts, such as JSON of lists; a null is a value of its own."""
    def same(c: str) -> Column:
        return F.count_distinct(F.coalesce(c, F.lit("\u0000"))) == 1

    names = ["same"] if facets == ("value",) else [f"same_{c}" for c in facets]
    return runs.groupBy("case_id").agg(F.count_distinct("run").alias("n_runs"), *(same(c).alias(n) for c, n in zip(facets, names)))


def rank_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, up, down, unchanged: items by how their ranks changed."""
    both = before.select("query_id", "item_id", F.col("rank").alias("r0")).join(after.select("query_id", "item_id", F.col("rank").alias("r1")), ["query_id", "item_id"])
    return movement(both)


def movement(both: DataFrame) -> DataFrame:
    """query_id, up, down, unchanged of items (query_id; r0 and r1, their ranks before and after)."""
    return both.groupBy("query_id").agg(F.count_if(F.col("r1") < F.col("r0")).alias("up"), F.count_if(F.col("r1") > F.col("r0")).alias("down"), F.count_if(F.col("r1") == F.col("r0")).alias("unchanged"))


def index_percentile(values: DataFrame, column: str, share: float, by: list[str]) -> DataFrame:
    """The element at floor(share * (n - 1)) of the sorted values of each group."""
    w = Window.partitionBy(*by).orderBy(column)
    placed = values.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return placed.filter(F.col("_at") == F.floor(share * (F.col("_n") - 1))).select(*by, column)


#: Stages in the order in which a failure is attributed.
STAGES = ("provider", "retrieval", "temporal", "reranking", "context", "generation", "verification", "citation")


def first_failures(failures: DataFrame) -> DataFrame:
    """case_id, primary_stage, stages of failures (case_id, stage, detail): the earliest stage that failed, and all of them."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return failures.groupBy("case_id").agg(F.min_by("stage", order).alias("primary_stage"), F.array_sort(F.collect_set("stage")).alias("stages"), F.count("*").alias("n"))


def gold_failures(units: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, stage, detail of evidence units (case_id, unit, pool_rank, dropped, rerank_rank, in_context) of the cases that
    should be answered (case_id, expect, status, abstention): where a unit was lost, and answers that should not be."""
    seen = units.join(expected.filter("expect = 'answer'").select("case_id"), "case_id", "left_semi")
    stage = F.when(F.col("pool_rank").isNull(), F.when(F.col("dropped"), "temporal").otherwise("retrieval")).when(F.col("rerank_rank").isNull() | (F.col("rerank_rank") > 10), "reranking").when(~F.col("in_context"), "context")
    lost = seen.withColumn("stage", stage).filter("stage IS NOT NULL").select("case_id", "stage", F.format_string("gold unit %d", "unit").alias("detail"))
    by_reason = F.when(F.col("abstention") == "provider_error", "provider").when(F.col("abstention") == "low_relevance", "reranking").when(F.col("abstention") == "no_evidence", "context").when(F.col("abstention") == "ungrounded_output", "verification").otherwise("generation")
    refused = expected.filter("expect = 'answer' AND status = 'abstain'").select("case_id", by_reason.alias("stage"), F.concat(F.lit("abstained: "), F.coalesce("abstention", F.lit("unknown"))).alias("detail"))
    wrong = expected.filter("expect = 'abstain' AND status = 'answer'").select("case_id", F.lit("generation").alias("stage"), F.lit("answered what should be abstained").alias("detail"))
    return lost.unionByName(refused).unionByName(wrong)


def holders(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, unit, own, quote, chunk_id, doc_id: each chunk (chunk_id, doc_id, text) that holds a quote (case_id, unit,
    doc_id, which becomes own, and quote), whatever the spaces of both. Quotes may be of any length, and stand within words."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = quotes.select("case_id", "unit", F.col("doc_id").alias("own"), plain("quote").alias("quote"))
    return contained(asked, chunks.select("chunk_id", "doc_id", plain("text").alias("text")))


def benchmark(quotes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, errors, notices) of a benchmark's quotes (case_id, unit, doc_id, quote) and chunks (chunk_id, doc_id, text).

    gold: case_id, unit, chunk_id: the only chunk of the document that holds the quote, whatever its spaces. errors: quotes
    that none holds, or several (n). notices: chunks of other documents that hold the quote too, short ones as well.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = quotes.withColumn("quote", plain("quote"))
    found = holders(quotes, chunks)
    hits = found.filter("doc_id = own").groupBy("case_id", "unit", "doc_id", "quote").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"))
    known = asked.join(hits.select("case_id", "unit", "doc_id", "quote", "n", "chunk_id"), ["case_id", "unit", "doc_id", "quote"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gold = known.filter("n = 1").select("case_id", "unit", "chunk_id").distinct()
    errors = known.filter("n != 1").select("case_id", "unit", "doc_id", "quote", "n")
    return gold, errors, found.filter("doc_id != own").select("case_id", "unit", "chunk_id").distinct()


def temporal_effect(cases: DataFrame, rankings: DataFrame, top: int = 10) -> DataFrame:
    """case_id, gold_before, gold_after, wrong_before, wrong_after of cases (case_id, item_id, kind: gold or wrong) and
    rankings (case_id, item_id, before, after: ranks or null): the worst rank of gold items, or null if one is not within
    the top, and how many wrong ones are."""
    seen = cases.join(rankings, ["case_id", "item_id"], "left")

    def gold(c: str) -> Column:
        own = F.col("kind") == "gold"
        lost = F.count_if(own & (F.col(c).isNull() | (F.col(c) > top)))
        return F.when(lost == 0, F.max(F.when(own, F.col(c)))).alias(f"gold_{c}")

    return seen.groupBy("case_id").agg(gold("before"), gold("after"), *(F.count_if((F.col("kind") == "wrong") & (F.col(c) <= top)).alias(f"wrong_{c}") for c in ("before", "after")))


#: Milliseconds from one word to the next of somebody who speaks.
WORD_MS = 400


def early_retrieval(utterances: DataFrame) -> DataFrame:
    """Adds early, false_trigger, lead_ms, done_early and overlap to utterances (n_words, trigger: a number of words or null,
    required, retrieval_ms, early_context and final_context: arrays of ids)."""
    hit = F.col("trigger").isNotNull()
    lead = (F.col("n_words") - F.col("trigger")) * WORD_MS
    both = F.size(F.array_intersect("early_context", "final_context")) / F.nullif(F.size("final_context"), F.lit(0))
    early = F.col("required") & hit
    return utterances.withColumns({"early": early, "false_trigger": ~F.col("required") & hit, "lead_ms": F.when(hit, lead), "done_early": early & (F.col("retrieval_ms") <= lead), "overlap": F.when(early, F.round(both, 3))})


def early_rates(measured: DataFrame) -> DataFrame:
    """utterances, eligible, early_rate, done_rate, false_rate, mean_lead_ms, mean_overlap over all utterances."""
    eligible, other = F.count_if("required"), F.count_if(~F.col("required"))

    def rate(n: Column, d: Column) -> Column:
        return F.round(n / F.nullif(d, F.lit(0)), 4)

    return measured.agg(F.count("*").alias("utterances"), eligible.alias("eligible"), rate(F.count_if("early"), eligible).alias("early_rate"), rate(F.count_if("done_early"), eligible).alias("done_rate"), rate(F.count_if("false_trigger"), other).alias("false_rate"), F.round(F.avg(F.when(F.col("early"), F.col("lead_ms"))), 1).alias("mean_lead_ms"), F.round(F.avg("overlap"), 3).alias("mean_overlap"))


def counterparts(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """chunk_id, counterpart: the only chunk of the other version (doc_id, other) that stands under the same path."""
    theirs = chunks.select(F.col("doc_id").alias("other"), F.col("chunk_id").alias("counterpart"), F.array_join("section_path", "\u0001").alias("path"))
    mine = chunks.join(versions, "doc_id").withColumn("path", F.array_join("section_path", "\u0001"))
    return mine.join(theirs, ["other", "path"]).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("counterpart").alias("counterpart")).filter("n = 1").drop("n")


def changed_rankings(saved: DataFrame, made: DataFrame) -> DataFrame:
    """case_id of the cases whose rankings (case_id, item_id, rank) are not the same."""
    lists = [df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias(name)) for df, name in ((saved, "a"), (made, "b"))]
    return lists[0].join(lists[1], "case_id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("case_id")


#: Upper bounds of the bins of chunk sizes.
BINS = (25, 50, 100, 150, 200, 256, 300, 400)


def size_bins(chunks: DataFrame, bounds: tuple[int, ...] = BINS) -> DataFrame:
    """bin (its upper bound; null beyond the last), n of chunks (tokens)."""
    at = F.coalesce(*(F.when(F.col("tokens") <= b, F.lit(b)) for b in bounds))
    return chunks.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def size_quantiles(chunks: DataFrame, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """share, tokens: the element at the rounded index share * (n - 1) of the sorted sizes. Sizes are counted first, so that
    only one row for each different size is sorted."""
    counts = chunks.groupBy("tokens").agg(F.count("*").alias("c"))
    w = Window.orderBy("tokens")
    upto = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    wanted = F.explode(F.array(*(F.struct(F.lit(s).alias("share")) for s in shares))).alias("s")
    at = upto.select("tokens", "upto", "n", wanted).filter(F.col("upto") > F.rint(F.col("s.share") * (F.col("n") - 1)))
    return at.groupBy(F.col("s.share").alias("share")).agg(F.min("tokens").alias("tokens"))


def repeated_texts(chunks: DataFrame) -> DataFrame:
    """content_hash, n, n_docs, across of texts that more than one chunk (doc_id, content_hash) has."""
    g = chunks.groupBy("content_hash").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).filter("n > 1")
    return g.withColumn("across", F.col("n_docs") > 1)


def report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A text of tables with bars, each with its name and at most so many rows; a longer one says how many are left out."""
    lines = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "/").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            lines.append(f"({df.count() - most} rows more)")
    return "\n".join(lines) + "\n"
