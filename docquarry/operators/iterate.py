"""Bounded iterative retrieval for a batch of questions: retrieve, assess, refine and merge, all questions of a round at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.dates import same_temporal_intent
from docquarry.functions.text import keyword_query

# Rounds at most, sources of a context, and the score from which a source is relevant.
MOST_ROUNDS, SHOWN, LEAST_SCORE = 3, 6, 0.0


def identity(query: Column) -> Column:
    """A query without regard to case and spaces: two of the same identity are one query."""
    return F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))


def coverage(evidence: DataFrame, questions: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """query_id, best, decision of evidence (query_id, score): sufficient if the best score reaches the least, or if there
    are no scores at all; insufficient without evidence or below it."""
    g = evidence.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    decided = F.when(F.coalesce("n", F.lit(0)) == 0, "insufficient").when(F.col("best").isNull() | (F.col("best") >= least), "sufficient").otherwise("insufficient")
    return questions.select("query_id").join(g, "query_id", "left").select("query_id", "best", decided.alias("decision"))


def assess(context: DataFrame, questions: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """query_id, best, gaps, decision, reason of what a context holds (query_id, organization, score).

    questions: query_id, organizations (named, of the corpus), outside (named, foreign), unavailable (whether a version
    that was asked for does not exist). In this order: a question of foreign institutions only is structural; nothing
    retrieved is insufficient; without scores it is sufficient; nothing relevant is structural if the version does not
    exist, else insufficient; an organization without a relevant source is a gap: insufficient; else sufficient.
    """
    by = context.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.collect_set(F.when(F.col("score") >= least, F.col("organization"))).alias("relevant"))
    seen = questions.join(by, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen = seen.withColumn("gaps", F.array_except("organizations", F.coalesce("relevant", F.array().cast("array<string>"))))
    reason = (
        F.when((F.size("outside") > 0) & (F.size("organizations") == 0), "outside_only")
        .when(F.col("n") == 0, "nothing_retrieved").when(F.col("best").isNull(), "unmeasured")
        .when((F.col("best") < least) & F.col("unavailable"), "version_unavailable").when(F.col("best") < least, "nothing_relevant")
        .when(F.size("gaps") > 0, "organization_gap").otherwise("relevant")
    )
    seen = seen.withColumn("reason", reason)
    decision = F.when(F.col("reason").isin("outside_only", "version_unavailable"), "structural").when(F.col("reason").isin("unmeasured", "relevant"), "sufficient").otherwise("insufficient")
    return seen.select("query_id", "best", "gaps", decision.alias("decision"), "reason")


def refinements(questions: DataFrame, coverages: DataFrame, strip: Callable[[Column, Column], Column]) -> DataFrame:
    """query_id, place, strategy, target, text: what may be asked next, in order: the question narrowed to each organization
    that has a gap, then its keywords. strip(text, names) removes organizations' names from a text."""
    open_questions = questions.join(coverages.filter("decision = 'insufficient'").select("query_id", "gaps"), "query_id")
    focus = open_questions.select("query_id", "text", "organizations", F.posexplode("gaps").alias("place", "target"))
    narrowed = F.regexp_replace(strip(F.col("text"), F.array_remove("organizations", F.col("target"))), r"[ ?.!]+$", "")
    focused = focus.select("query_id", "place", F.lit("organization_focus").alias("strategy"), "target", F.concat(narrowed, F.lit(" ("), "target", F.lit(")")).alias("text"))
    words = open_questions.select("query_id", F.size("gaps").alias("place"), F.lit("keyword_focus").alias("strategy"), F.lit(None).cast("string").alias("target"), keyword_query(F.col("text")).alias("text"))
    return focused.unionByName(words)


def next_queries(proposed: DataFrame, questions: DataFrame, issued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, strategy, target, text: the first proposal that is new and asks for the same time; query_id, strategy, text,
    why: the ones before it). issued: query_id, identity of what was asked already."""
    known = issued.select("query_id", "identity", F.lit(True).alias("known")).distinct()
    seen = proposed.withColumn("identity", identity(F.col("text"))).join(known, ["query_id", "identity"], "left").join(questions.select("query_id", F.col("text").alias("whole")), "query_id")
    seen = seen.withColumn("same", same_temporal_intent("whole", "text"))
    seen = seen.withColumn("why", F.when(F.col("identity") == "", "empty").when(F.col("known"), "already issued").when(~F.col("same"), "would change the temporal intent"))
    first = F.min(F.when(F.col("why").isNull(), F.col("place"))).over(Window.partitionBy("query_id"))
    placed = seen.withColumn("first", first)
    taken = placed.filter("place = first AND why IS NULL").select("query_id", "strategy", "target", "text")
    skipped = placed.filter("why IS NOT NULL AND (first IS NULL OR place < first)").select("query_id", "strategy", "text", "why")
    return taken, skipped


def promote(ranked: DataFrame, questions: DataFrame, k: int, shown: int = SHOWN, least: float = LEAST_SCORE) -> DataFrame:
    """query_id, item_id, rank, promoted of merged evidence (query_id, item_id, organization, score, rank): for each
    organization that a question names (organizations) and that has no relevant item among the shown ones, the best
    relevant item moves to the last places that are shown, never to the first. At most max(k, shown) rows a question."""
    item = F.struct("rank", "item_id", "organization", "score")
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(questions.select("query_id", "organizations"), "query_id")

    def place(items: list, organizations: list[str]) -> list[tuple]:
        moved: list = []
        for o in organizations:
            rest = [x for x in items if x not in moved]
            window = shown - len(moved)
            own = [i for i, x in enumerate(rest) if x["organization"] == o and x["score"] is not None and x["score"] >= least]
            if own and own[0] >= window and window > 1:
                moved.append(rest[own[0]])
        rest = [x for x in items if x not in moved]
        cut = shown - len(moved)
        return [(x["item_id"], x in moved) for x in rest[:cut] + moved + rest[cut:]][: max(k, shown)]

    kind = ranked.schema
    out = f"query_id {kind['query_id'].dataType.simpleString()}, item_id {kind['item_id'].dataType.simpleString()}, rank long, promoted boolean"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(r["query_id"], item, rank, moved) for r in batch.to_pylist() for rank, (item, moved) in enumerate(place(r["items"], r["organizations"] or []), 1)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [batch.schema.field("query_id").type, batch.schema.field("items").type.value_type.field("item_id").type, pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "item_id", "rank", "promoted"])

    return lists.mapInArrow(run, out)


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, organization, score, rank of all rounds (query_id, round, item_id, rank, score, organization): each
    item once, by score, or as it was first seen where any item of the question has none."""
    first = found.groupBy("query_id", "item_id").agg(F.min(F.struct("round", "rank")).alias("f"), F.max("score").alias("score"), F.first("organization").alias("organization"))
    scored = F.every(F.col("score").isNotNull()).over(Window.partitionBy("query_id"))
    first = first.withColumn("by", F.when(scored, -F.col("score")).otherwise(0.0))
    w = Window.partitionBy("query_id").orderBy("by", "f", "item_id")
    return first.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "item_id", "organization", "score", "rank")


def iterate(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataFrame], k: int = 10, rounds: int = MOST_ROUNDS, least: float = LEAST_SCORE, strip: Callable[[Column, Column], Column] | None = None, rescore: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged evidence, trace). retrieve: questions (query_id, text) -> query_id, item_id, rank, score (and organization);
    write: writes a table and returns what is read again, so that no round's plan holds the former ones.

    questions: query_id, text, and organizations, outside, unavailable where they are known. A question that the first
    round answers keeps that round's evidence as it is. The others are asked again, narrowed to the organizations that
    have a gap or by their keywords, as long as that is a new query for the same time; all their rounds are merged. rescore
    (query_id, item_id -> with score) scores what later rounds find against the question itself. The
    trace has a row for each round of a question: round, strategy, target, decision, reason, best, and stop (sufficient,
    structural, max_rounds or no_refinement) in the last one.
    """
    none = F.array().cast("array<string>")
    defaults = {"organizations": none, "outside": none, "unavailable": F.lit(False)}
    whole = write(questions.withColumns({c: v for c, v in defaults.items() if c not in questions.columns}).select("query_id", "text", *defaults), "questions")
    asked = write(whole.select("query_id", "text", F.lit("initial").alias("strategy"), F.lit(None).cast("string").alias("target")), "asked-0")
    issued, found, trace = asked.select("query_id", identity(F.col("text")).alias("identity")), None, None
    for number in range(rounds):
        got = retrieve(asked.select("query_id", "text"))
        got = got if "organization" in got.columns else got.withColumn("organization", F.lit(None).cast("string"))
        if number and rescore is not None:
            got = got.drop("score").join(rescore(got.select("query_id", "item_id").distinct()), ["query_id", "item_id"], "left")
        got = write(got.select("query_id", "item_id", "rank", "score", "organization").withColumn("round", F.lit(number)), f"round-{number}")
        found = got if found is None else found.unionByName(got)
        open_questions = whole.join(asked.select("query_id"), "query_id", "left_semi")
        context = merged(found.join(asked.select("query_id"), "query_id", "left_semi"), SHOWN)
        cover = write(assess(context, open_questions, least), f"coverage-{number}")
        taken, skipped = next_queries(refinements(open_questions, cover, strip or (lambda text, names: text)), whole, issued)
        taken = write(taken, f"asked-{number + 1}")
        more = taken.select("query_id", F.lit(True).alias("more"))
        stop = F.when(F.col("decision") != "insufficient", F.col("decision")).when(F.lit(number + 1 == rounds), "max_rounds").when(F.col("more").isNull(), "no_refinement")
        rows = cover.join(asked.select("query_id", "strategy", "target"), "query_id").join(more, "query_id", "left").select("query_id", F.lit(number).alias("round"), "strategy", "target", "decision", "reason", "best", stop.alias("stop"))
        rows = rows.join(skipped.groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "strategy", "why"))).alias("skipped")), "query_id", "left")
        rows = write(rows, f"trace-{number}")
        trace = rows if trace is None else trace.unionByName(rows)
        if number + 1 == rounds or taken.isEmpty():
            break
        asked = taken
        issued = issued.unionByName(taken.select("query_id", identity(F.col("text")).alias("identity")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "round", "rank", "item_id")
    once = found.groupBy("query_id", "item_id").agg(F.min(F.struct("round", "rank", "score")).alias("f")).select("query_id", "item_id", "f.*")
    return once.withColumn("merged_rank", F.row_number().over(w).cast("long")).filter(F.col("merged_rank") <= k), trace
