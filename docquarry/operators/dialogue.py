"""Conversations: how turns are read, what late constraints add, refined answers, their versions, and stored sessions."""

from __future__ import annotations

from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docquarry.functions import dialogue as D
from docquarry.functions.intents import Directory, decompose
from docquarry.operators.ordered import scan_documents

READING = "conv_id long, turn long, kind string, reason string, query string, topic array<string>, time string, organizations array<string>, anchor long, delta string, retrieval_query string"


@F.pandas_udf(ArrayType(StringType()))
def references(text: pd.Series) -> pd.Series:
    """The words by which a question refers to the conversation."""
    return text.map(lambda t: D.references(t or ""))


@F.pandas_udf(StringType())
def late_constraint(text: pd.Series) -> pd.Series:
    """The constraint that an utterance adds, or null."""
    return text.map(lambda t: D.late_constraint(t or ""))


def new_words(constraint: Column, earlier: Column) -> Column:
    """Words of a constraint, in order, that carry content and that no earlier text (an array) holds."""
    token = F.lit(r"[A-Za-z0-9][\w'’-]*")
    known = F.flatten(F.transform(earlier, lambda t: F.regexp_extract_all(F.lower(t), token, F.lit(0))))
    words = F.regexp_extract_all(constraint, token, F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(known, F.lower(w)) & ~F.lower(w).isin(sorted(D.FUNCTION_WORDS))), " ")


def topic_phrase(text: Column) -> Column:
    """A question without its mark and without What is, What are or What about."""
    body = F.trim(F.regexp_replace(F.trim(text), r"\?+$", ""))
    return F.trim(F.regexp_replace(body, r"(?i)^(?:(?:what|which)\s+(?:is|are|was|were)|what\s+about|how\s+about)\s+(?:the\s+)?", ""))


def read_turns(turns: DataFrame, directory: Directory) -> DataFrame:
    """How each question of conversations (conv_id, turn, text, kind) is read after the last one that was asked: READING.

    kind is the gate's: only turns to retrieve are read; the others (thanks, layouts, unfinished ones) leave the session as
    it is. A session holds the last question and how it was read, nothing else.
    """
    def scan(rows: list[dict]) -> list[dict]:
        last, out = None, []
        for r in rows:
            if r["kind"] != "retrieve":
                continue
            text = r["text"] or ""
            reading = D.read(text, last, directory.mentions(text), directory.outside(text))
            own = asdict(reading)
            out.append({"conv_id": r["conv_id"], "turn": r["turn"], **{k: own[k] for k in ("kind", "reason", "query", "topic", "time", "organizations", "anchor", "delta", "retrieval_query")}})
            n = len(decompose(reading.query or text, directory)[0]) if reading.kind == D.SELF_CONTAINED else 1
            last = D.Turn(r["turn"], text, reading, n)
        return out

    return scan_documents(turns.select("conv_id", "turn", "text", "kind"), scan, READING, key="conv_id", order=("turn",))


def merged_answers(old: DataFrame, new: DataFrame, chunks: DataFrame, selected: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """answer_id, place, origin (kept, replaces, new, dropped, replaced), text, note: the claims of refined answers.

    old, new: answer_id, claim, text, sources (array of item ids). chunks: item_id, series_id, doc_id. selected: answer_id,
    series_id, doc_ids. accepted: answer_id, text of old claims that the verifier accepts on the merged evidence (all, if
    it is not given). Answers hold a few claims, so that each is one value.
    """
    claim = F.struct("claim", "text", "sources")
    lists = [df.groupBy("answer_id").agg(F.array_sort(F.collect_list(claim)).alias(name)) for df, name in ((old, "old"), (new, "new"))]
    cited = old.unionByName(new).select("answer_id", F.explode("sources").alias("item_id")).distinct().join(chunks.select("item_id", "series_id", "doc_id"), "item_id")
    known = cited.groupBy("answer_id").agg(F.collect_list(F.struct("item_id", "series_id", "doc_id")).alias("known"))
    chosen = selected.groupBy("answer_id").agg(F.collect_list(F.struct("series_id", "doc_ids")).alias("chosen"))
    rows = lists[1].join(lists[0], "answer_id", "left").join(known, "answer_id", "left").join(chosen, "answer_id", "left")
    rows = rows.join(accepted.groupBy("answer_id").agg(F.collect_set("text").alias("good")), "answer_id", "left") if accepted is not None else rows.withColumn("good", F.lit(None).cast("array<string>"))
    kind = new.schema["answer_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                own = {name: [] if r[name] is None else list(r[name]) for name in ("old", "new", "known", "chosen")}
                before, after = ([{"text": c["text"], "sources": [str(s) for s in c["sources"]]} for c in own[n]] for n in ("old", "new"))
                of = {str(k["item_id"]): (k["series_id"], k["doc_id"]) for k in own["known"]}
                good = None if r["good"] is None else set(r["good"])
                fresh = {c["text"] for c in after}
                made = D.merge_claims(before, after, of, {c["series_id"]: list(c["doc_ids"]) for c in own["chosen"]}, lambda claims: {i for i, c in enumerate(claims) if good is not None and c["text"] not in good | fresh})
                claims = [("new", c) for c in after] if made is None else made.claims
                out += [(r["answer_id"], i, origin, c["text"], None) for i, (origin, c) in enumerate(claims)]
                if made is not None:
                    out += [(r["answer_id"], None, "dropped", text, why) for text, why in made.dropped] + [(r["answer_id"], None, "replaced", text, by) for text, by in made.replaced]
            yield pd.DataFrame(out, columns=["answer_id", "place", "origin", "text", "note"]).astype({"place": "Int64"})

    return rows.select("answer_id", "old", "new", "known", "chosen", "good").mapInPandas(run, f"answer_id {kind}, place long, origin string, text string, note string")


def answer_versions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, first_turn, version of turns (conv_id, turn, kind, anchor): a refinement is the next version of the
    answer of its anchor; a presentation lays out the version of its anchor."""
    def scan(rows: list[dict]) -> list[dict]:
        made = D.lineage([(r["turn"], r["kind"], r["anchor"]) for r in rows if r["kind"] != "presentation"])
        shown = {r["turn"]: made.get(r["anchor"], (r["turn"], 1)) for r in rows if r["kind"] == "presentation"}
        return [{"conv_id": rows[0]["conv_id"], "turn": t, "first_turn": f, "version": v} for t, (f, v) in sorted((made | shown).items())]

    return scan_documents(turns.select("conv_id", "turn", "kind", "anchor"), scan, "conv_id long, turn long, first_turn long, version int", key="conv_id", order=("turn",))


def statement_similarity(a: Column, b: Column) -> Column:
    """The share of the content words of two claims that both have; 0 if either has none."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:[.,]\d+)*"), F.lit(0)), lambda w: ~w.isin(sorted(D.CLAIM_STOP))))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def sentence(text: Column, label: Column, marks: Column) -> Column:
    """A claim as it is laid out: the version it is of, its text with a full stop, and its citations (an array of numbers)."""
    closed = F.when(text.rlike(r"[.?!]$"), text).otherwise(F.concat(text, F.lit(".")))
    return F.concat(F.coalesce(F.concat(label, F.lit(": ")), F.lit("")), closed, F.array_join(F.transform(marks, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))


def responses(turns: DataFrame) -> DataFrame:
    """What is told of turns (request_id, conv_id, turn, kind, status, text, shown: the item ids of all its parts, in order):
    the ids once each, in order."""
    return turns.select("request_id", "conv_id", "turn", "kind", "status", "text", F.array_distinct("shown").alias("evidence"))


class SessionStore:
    """Sessions by their key in a folder: put() replaces whole sessions, and the last write of a key counts.

    Writes are appended with their number, so that a reader sees a put as a whole or not at all; compact() writes the
    sessions that are left anew. The number of puts between is the caller's, such as a batch id of a stream.
    """

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder.rstrip("/"), schema

    def _write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/put={number}")

    def put(self, sessions: DataFrame, number: int) -> None:
        """sessions: session_id, body."""
        self._write(sessions.select("session_id", "body", F.lit(False).alias("gone")), number)

    def delete(self, keys: DataFrame, number: int) -> None:
        self._write(keys.select("session_id", F.lit(None).cast("string").alias("body"), F.lit(True).alias("gone")), number)

    def sessions(self, spark) -> DataFrame:
        """session_id, body of what is stored."""
        rows = spark.read.schema("session_id string, body string, gone boolean, put long").option("basePath", self.folder).parquet(f"{self.folder}/put=*")
        last = Window.partitionBy("session_id").orderBy(F.col("put").desc())
        return rows.withColumn("nth", F.row_number().over(last)).filter("nth = 1 AND NOT gone").select("session_id", "body")

    def get(self, spark, keys: DataFrame) -> DataFrame:
        return self.sessions(spark).join(keys.select("session_id").distinct(), "session_id", "left_semi")

    def compact(self, spark, number: int) -> None:
        """Writes all that is left under a number that comes after every put so far."""
        self.put(self.sessions(spark), number)
