"""Questions of several needs: organizations they name, the parts they fall into, and how parts are answered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.functions import intents as I

def mentioned(questions: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, organizations: those of a table of names (name, organization, exact) that a question holds, in the order
    of their first place. Full names match in any case, short ones (exact) as they are written, with a possessive."""
    # questions meet names by the first word of a name, so that no question is compared with all names
    first = lambda c: F.lower(F.regexp_extract(c, r"(?U)[\w&]+", 0))
    words = questions.select("query_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\w&]+"), F.lit(0)))).alias("word"))
    met = words.join(names.withColumn("word", first(F.col("name"))), "word")
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("name"), F.lit(r"\E(?:['’]s)?(?!\w)"))
    pattern = F.when(F.col("exact"), quoted).otherwise(F.concat(F.lit("(?i)"), quoted))
    at = met.withColumn("at", F.regexp_instr("text", pattern)).filter("at > 0")
    found = at.groupBy("query_id", "organization").agg(F.min("at").alias("at"))
    lists = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "organization"))), lambda x: x["organization"]).alias("organizations"))
    return questions.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("organizations", F.array().cast("array<string>")).alias("organizations"))


def outside(text: str, known: list[str]) -> list[str]:
    """Names of institutions in a text that no known name holds or is held by."""
    return I.Directory(list(known)).outside(text)


def parts_of(question: str, directory: I.Directory | None = None) -> list[str]:
    """The questions that a question consists of; the question alone if it is one."""
    return [x.text for x in I.decompose(question, directory or I.Directory([]))[0]]


def decompose(questions: DataFrame, directory: I.Directory | None = None) -> DataFrame:
    """query_id, intent (from 0), text: the parts of questions (query_id, text)."""
    return intents(questions, directory or I.Directory([])).select("query_id", "intent", "text")


def intents(questions: DataFrame, directory: I.Directory) -> DataFrame:
    """query_id, intent (from 0), text, sub_query, organizations, carried, outside, topic, flags of questions (query_id, text).

    The directory holds the names of a corpus' organizations: some hundreds, which are sent with the task.
    """
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for q, t in zip(pdf.query_id, pdf.text):
            made, _, flags = I.decompose(t or "", directory)
            rows += [(q, k, x.text, x.sub_query, x.organizations, x.carried, x.outside, x.topic, flags) for k, x in enumerate(made)]
        return pd.DataFrame(rows, columns=["query_id", "intent", "text", "sub_query", "organizations", "carried", "outside", "topic", "flags"])

    names = "array<string>"
    schema = f"query_id long, intent long, text string, sub_query string, organizations {names}, carried {names}, outside {names}, topic string, flags {names}"
    return questions.select("query_id", "text").mapInPandas(lambda it: map(split, it), schema)


def stripped(directory: I.Directory):
    """strip(text, names) for iterate.refinements(): a text without these organizations' names."""
    @F.pandas_udf(StringType())
    def strip(text: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([directory.strip(t or "", list(n) if n is not None else []) for t, n in zip(text, names)])

    return strip


def aligned(rankings: DataFrame, pools: DataFrame, questions: DataFrame, directory: I.Directory, k: int) -> DataFrame:
    """query_id, item_id, rank of rankings (query_id, item_id, rank, organization, text) that are aligned with the things
    that their questions (query_id, text) name; pools are the same rankings to a greater depth (a few rows a question)."""
    row = F.struct("rank", "item_id", "organization", "text")
    lists = [df.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias(name)) for df, name in ((rankings, "first"), (pools, "pool"))]
    asked = questions.select("query_id", F.col("text").alias("question")).join(lists[0], "query_id").join(lists[1], "query_id", "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                first, pool = ([(x["item_id"], x["organization"], x["text"] or "") for x in (own if own is not None else [])] for own in (r.first, r.pool))
                named = I.entities(r.question or "", directory)
                rows += [(r.query_id, x[0], n) for n, x in enumerate(I.align(named, directory.mentions(r.question or ""), first, pool, k), 1)]
            yield pd.DataFrame(rows, columns=["query_id", "item_id", "rank"])

    return asked.mapInPandas(run, "query_id long, item_id long, rank long")


def carry(intents: DataFrame) -> DataFrame:
    """Adds carried and ambiguous to intents (query_id, intent, organizations): a part that names no organization gets the
    one that all others name; several are ambiguous."""
    others = F.array_distinct(F.flatten(F.collect_list("organizations").over(Window.partitionBy("query_id"))))
    empty = F.size("organizations") == 0
    none = F.array().cast("array<string>")
    return intents.withColumn("_o", others).withColumn("carried", F.when(empty & (F.size("_o") == 1), F.col("_o")).otherwise(none)).withColumn("ambiguous", empty & (F.size("_o") > 1)).drop("_o")


def within_boundary(evidence: DataFrame) -> DataFrame:
    """Evidence (organization, organizations) of the organizations that an intent names; unknown ones stay."""
    return evidence.filter((F.size("organizations") == 0) | F.col("organization").isNull() | F.array_contains("organizations", F.col("organization")))


def admissible(runs: DataFrame) -> DataFrame:
    """query_id, intent, admissible: whether a run (with outside, a count of foreign institutions, and score) may be used."""
    g = runs.groupBy("query_id", "intent").agg(F.count("item_id").alias("n"), F.max("score").alias("best"), F.max("outside").alias("outside"))
    return g.select("query_id", "intent", ((F.col("outside") == 0) & (F.col("n") > 0) & (F.col("best").isNull() | (F.col("best") >= 0))).alias("admissible"))


def covered(tops: DataFrame, context: DataFrame) -> DataFrame:
    """Adds covered to the best items of intents (query_id, intent, item_id, content_hash): whether the question's own
    context (query_id, item_id, content_hash) holds the item or its text."""
    by_id = context.select("query_id", "item_id", F.lit(True).alias("_i")).distinct()
    by_hash = context.select("query_id", "content_hash", F.lit(True).alias("_h")).distinct()
    seen = tops.join(by_id, ["query_id", "item_id"], "left").join(by_hash, ["query_id", "content_hash"], "left")
    return seen.withColumn("covered", F.coalesce("_i", "_h", F.lit(False))).drop("_i", "_h")


def strategy(flags: DataFrame) -> DataFrame:
    """query_id, strategy of flags (query_id, intent, admissible, covered; blocked: it names a foreign institution; same:
    it selects the versions that the whole question does).

    delegate: one intent, or none that may be used is uncovered and none is blocked. no_supported_intent: none may be
    used. fused: all that may be used select the same versions as the question. per_intent otherwise.
    """
    flags = flags.withColumns({c: F.lit(v) for c, v in (("blocked", False), ("same", True)) if c not in flags.columns})
    g = flags.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("admissible").alias("ok"), F.count_if(F.col("admissible") & ~F.col("covered")).alias("open"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("admissible") & ~F.col("same")).alias("other"))
    return g.select("query_id", F.when(F.col("n") == 1, "delegate").when((F.col("open") == 0) & (F.col("blocked") == 0), "delegate").when(F.col("ok") == 0, "no_supported_intent").when(F.col("other") == 0, "fused").otherwise("per_intent").alias("strategy"))


def intents_of(items: DataFrame, runs: DataFrame) -> DataFrame:
    """query_id, item_id, entries: for each item that was shown (query_id, item_id), the intents whose own lists (query_id,
    intent, item_id, rank, score) hold it, with its rank and score there."""
    held = runs.groupBy("query_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("intent", "rank", "score"))).alias("entries"))
    return items.select("query_id", "item_id").distinct().join(held, ["query_id", "item_id"], "left")


def claim_intents(claims: DataFrame, associations: DataFrame) -> DataFrame:
    """query_id, claim, intents: the intents that the items a claim cites (query_id, claim, item_id) belong to
    (query_id, item_id, intent)."""
    found = claims.join(associations.select("query_id", "item_id", "intent"), ["query_id", "item_id"], "left")
    return found.groupBy("query_id", "claim").agg(F.array_sort(F.collect_set("intent")).alias("intents"))


def version_slices(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Evidence (query_id, item_id, series_id, doc_id, rank) once for each version (query_id, split_series, split_doc) of the
    series that an answer is split on: without the other versions of that series, ranks as they are."""
    both = evidence.join(versions.select("query_id", "split_series", "split_doc"), "query_id")
    return both.filter(~F.col("series_id").eqNullSafe(F.col("split_series")) | (F.col("doc_id") == F.col("split_doc")))


def split_decision(answers: DataFrame) -> DataFrame:
    """query_id, strategy of answers (query_id, series: the one to split on or null, abstention, n_problems,
    n_version_problems): split_by_version only if the one answer was refused for nothing but its versions."""
    only = (F.col("abstention") == "ungrounded_output") & (F.col("n_version_problems") > 0) & (F.col("n_version_problems") == F.col("n_problems"))
    return answers.select("query_id", F.when(F.col("series").isNotNull() & F.coalesce(only, F.lit(False)), "split_by_version").otherwise("single").alias("strategy"))


def combined(parts: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One answer of several parts: (query_id, status, text; query_id, item_id, number; query_id, gap).

    parts: query_id, part, label, status, reason, gaps (array). claims: query_id, part, claim, text, items (cited, in
    order). Citations are numbered by their first use over all parts; a part without an answer is a sentence and a gap.
    """
    uses = claims.select("query_id", "part", "claim", F.posexplode("items").alias("at", "item_id"))
    first = uses.groupBy("query_id", "item_id").agg(F.min(F.struct("part", "claim", "at")).alias("first"))
    numbers = first.select("query_id", "item_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long").alias("number"))
    marked = uses.join(numbers, ["query_id", "item_id"]).groupBy("query_id", "part", "claim").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("m"))
    closed = F.when(F.col("text").rlike(r"[.?!]$"), F.col("text")).otherwise(F.concat("text", F.lit(".")))
    marks = F.array_join(F.transform(F.coalesce("m", F.array().cast("array<struct<at: int, number: bigint>>")), lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("]"))), "")
    sentences = claims.join(marked, ["query_id", "part", "claim"], "left").select("query_id", "part", "claim", F.concat(closed, marks).alias("s"))
    said = sentences.groupBy("query_id", "part").agg(F.array_sort(F.collect_list(F.struct("claim", "s"))).alias("ss"))
    rows = parts.join(said, ["query_id", "part"], "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))
    answered = F.col("status") == "answered"
    missing = F.when(F.size("gaps") > 0, F.concat(F.lit(" Not in the sources: "), F.array_join(F.transform("gaps", lambda g: F.regexp_replace(g, r"\.+$", "")), "; "), F.lit("."))).otherwise("")
    body = F.when(answered, F.concat(F.array_join(F.transform("ss", lambda x: x["s"]), " "), missing)).otherwise("the retrieved sources do not answer this part.")
    sections = rows.select("query_id", "part", "status", F.concat("label", F.lit(": "), body).alias("section"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "section"))), lambda x: x["section"]), "\n")
    answers = sections.groupBy("query_id").agg(F.when(F.count_if(answered) > 0, "answered").otherwise("abstained").alias("status"), text.alias("text"))
    no_answer = F.concat("label", F.lit(": no verified answer ("), F.coalesce("reason", F.lit("unknown")), F.lit(")"))
    gaps = rows.select("query_id", F.explode(F.when(answered, F.transform("gaps", lambda g: F.concat("label", F.lit(": "), g))).otherwise(F.array(no_answer))).alias("gap"))
    return answers, numbers, gaps


def unsupported(intent_rows: DataFrame) -> DataFrame:
    """query_id, status, gaps of questions none of whose intents (query_id, intent, text, outside) may be used: they are not
    answered, and say for each part why."""
    why = F.when(F.size("outside") > 0, F.concat(F.lit("this part names an organization outside the corpus ("), F.array_join("outside", ", "), F.lit(")"))).otherwise("no relevant evidence was retrieved for this part")
    gap = F.concat(F.lit("Part "), (F.col("intent") + 1).cast("string"), F.lit(" ("), "text", F.lit("): "), why)
    rows = intent_rows.select("query_id", "intent", gap.alias("gap"))
    return rows.groupBy("query_id").agg(F.lit("abstained").alias("status"), F.transform(F.array_sort(F.collect_list(F.struct("intent", "gap"))), lambda x: x["gap"]).alias("gaps"))
