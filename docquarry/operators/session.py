"""Conversations: what an utterance is, when a question can be foreseen, and how answers are laid out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vocabularies of utterances.
CANNOT_END = "a an the and or but nor of between if whether my your their its our".split()
OPENER = "what which who whom whose when where why how is are was were do does did can could should would will must".split()
ACKNOWLEDGE = "thanks thank thx ty ok okay great perfect bye goodbye cheers understood noted done appreciated appreciate".split()
SMALL_TALK = ACKNOWLEDGE + (
    "you very much so a lot that that's thats is all it got for the help now i i'm im am good no more further questions "
    "question nothing else this was helpful really awesome excellent cool nice sounds fine alright yes yep yeah sure will "
    "would be do set have need needed wanted everything makes sense clear right then well just and my your answer answers "
    "information info again today"
).split()
REQUEST = (
    "give show put format reformat rewrite restate present list write turn convert make break lay out down can could would "
    "will you please me us i i'd want need like it that this the answer response reply above previous last again same them "
    "those these in as into to a an of with using just now only instead form bullet bullets bulleted point points numbered "
    "number one two three four five six seven eight nine ten"
).split()
# Phrases that close a conversation, and how an utterance ends that is not finished or is.
CLOSING = r"\bgot it\b|\bthat(?:'s| is| will be| would be)? all\b|\bno (?:more|further) questions?\b|\bnothing (?:else|more|further)\b|\ball (?:good|set|clear)\b"
TRAILS_OFF, CLOSED, OPEN_MARK, POSSESSIVE = r"(?:\.{2,}|…)\s*$", r"[.?!][\"'”’)\]]*\s*$", r"[,;:(/&\-–—]\s*$", r"['’]s\s*$"
MOST_OPENER, MOST_ACKNOWLEDGE, MOST_REQUEST, EARLY_WORDS = 3, 10, 14, 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit("[a-z0-9']+"), F.lit(0))


def turn_kind(text: Column) -> Column:
    """suppress (thanks and the like), presentation (another layout), wait (unfinished) or retrieve, in this order."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    w = words(plain)
    thanks = ~F.contains(plain, F.lit("?")) & F.size(w).between(1, MOST_ACKNOWLEDGE) & F.forall(w, lambda x: x.isin(SMALL_TALK)) & (F.exists(w, lambda x: x.isin(ACKNOWLEDGE)) | F.array_join(w, " ").rlike(CLOSING))
    number = r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)"
    layout = rf"\b(?:bullet(?:ed)?|bullets|numbered)\b|\b(?!0+\s){number}\s+points\b"
    present = F.size(w).between(1, MOST_REQUEST) & F.forall(w, lambda x: x.isin(REQUEST) | x.rlike(r"^\d+$")) & F.array_join(w, " ").rlike(layout)
    last = F.try_element_at(w, F.lit(-1))
    opened = plain.rlike(TRAILS_OFF) | (~plain.rlike(CLOSED) & (plain.rlike(OPEN_MARK) | plain.rlike(POSSESSIVE) | F.coalesce(last.isin(CANNOT_END) | ((F.size(w) <= MOST_OPENER) & last.isin(OPENER)), F.lit(False))))
    return F.when(thanks, "suppress").when(present, "presentation").when(opened, "wait").otherwise("retrieve")


def content_words(text: Column, leave_out: list[str]) -> Column:
    """Words that say what a text is about."""
    return F.filter(words(text), lambda x: ~x.isin(leave_out) & ~x.rlike(r"^\d+$"))


def first_trigger(turns: DataFrame, keys: list[str], leave_out: list[str], least: int = EARLY_WORDS) -> DataFrame:
    """The keys, n_words, and trigger: how many words must be heard before enough of them are content words (else null)."""
    heard = turns.select(*keys, F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("at", "word"))
    counted = heard.withColumn("c", F.size(content_words(F.col("word"), leave_out)))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = counted.withColumn("so_far", F.sum("c").over(w))
    return so_far.groupBy(*keys).agg(F.count("*").alias("n_words"), (F.min(F.when(F.col("so_far") >= least, F.col("at"))) + 1).cast("long").alias("trigger"))


def context_turn(turns: DataFrame) -> DataFrame:
    """Adds context_turn: the last earlier turn of the conversation that was a question."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("context_turn", F.last(F.when(F.col("is_question"), F.col("turn")), ignorenulls=True).over(w))


def present(claims: DataFrame, n: int) -> DataFrame:
    """answer_id, item, text: claims (answer_id, claim, text) in n items, the first ones with one more where n does not divide."""
    w = Window.partitionBy("answer_id").orderBy("claim")
    items = claims.withColumn("item", F.ntile(n).over(w).cast("long"))
    return items.groupBy("answer_id", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", "text"))), lambda x: x["text"]), " ").alias("text"))


def fragments_joined(turns: DataFrame) -> DataFrame:
    """conv_id, turn, utterance: a turn that waits is put before the next one; a turn that repeats it takes its place."""
    schema = "conv_id long, turn long, kind string, utterance string"

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, held = [], ""
        for r in pdf.sort_values("turn").itertuples():
            tail = " ".join((r.text or "").split())
            head = held.rstrip(". …") if held else ""
            said = tail if not head or tail.lower().startswith(head.lower()) else f"{head} {tail}"
            held = said if r.kind == "wait" else ""
            rows.append((r.conv_id, r.turn, r.kind, said))
        return pd.DataFrame(rows, columns=["conv_id", "turn", "kind", "utterance"])

    return turns.select("conv_id", "turn", "kind", "text").groupBy("conv_id").applyInPandas(scan, schema)
