"""Verdicts and records."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.operators import records, verify


def answer(*claims, status="answered"):
    return json.dumps({"status": status, "claims": [{"text": t, "sources": s, "quotes": q} for t, s, q in claims], "not_in_sources": [], "abstention_reason": None})


SOURCE = "Travelers must file within 30 days of July 1, 2026. The “daily limit” is $1,000.00 • per trip."


@pytest.mark.parametrize("body, want", [
    (answer(("File within 30 days.", ["S1"], ["file within 30 days"])), []),
    (answer(("The limit is 1000.", ["S1"], ['the "daily limit" is ... per trip'])), []),
    (answer(("File within 45 days.", ["S1"], ["file within 30 days"])), [(0, "number_not_in_sources")]),
    (answer(("Asked about 99 things.", ["S1"], ["must file within"])), []),
    (answer(("From July 2, 2026.", ["S1"], ["Travelers must file"])), [(0, "date_not_in_sources"), (0, "number_not_in_sources")]),
    (answer(("From July 2026.", ["S1"], ["Travelers must file"])), []),
    (answer(("x", ["S1"], ["per trip ... Travelers must"])), [(0, "quote_not_found")]),
    (answer(("x", ["S1"], ["must"])), [(0, "short_quote")]),
    (answer(("x", [], [])), [(0, "no_source")]),
    (answer(("x", ["S9"], [])), [(0, "unknown_source")]),
    (answer(status="answered"), [(None, "no_claims")]),
    (answer(status="abstained"), []),
    (answer(("x", ["S1"], []), status="maybe"), [(None, "unknown_status")]),
    ("not json", [(None, "not_a_document")]),
    (None, [(None, "not_a_document")]),
])
def test_verdicts(spark, body, want):
    answers = spark.createDataFrame([(1, body)], "answer_id long, body string")
    sources = spark.createDataFrame([(1, "S1", SOURCE)], "answer_id long, label string, text string")
    asked = spark.createDataFrame([(1, "What of 99 things?")], "answer_id long, question string")
    found = verify.problems(answers, sources, asked)
    assert sorted(((r.claim, r.problem) for r in found.collect()), key=str) == sorted(want, key=str)
    assert verify.verdicts(answers, found).first().accepted == (not want)


@pytest.mark.parametrize("text, want", [("July 1, 2026", "2026-07-01"), ("Jul 1st, 2026", "2026-07-01"), ("2026-07-01", "2026-07-01"), ("7/1/2026", "2026-07-01"), ("1 July 2026", "2026-07-01"), ("July 2026", "2026-07"), ("2026", None), ("soon", None), (None, None)])
def test_normalized_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(records.normalized_date(F.col("t")).alias("d")).first().d == want


def test_labelled_fields_and_priority(spark):
    rows = [("d", 1, 1, "Effective Date: July 1, 2026"), ("d", 2, 1, "Policy Owner:"), ("d", 3, 1, "Finance"), ("d", 4, 1, "Note: nothing"), ("d", 5, 3, "Effective Date: too late")]
    blocks = spark.createDataFrame(rows, "doc_id string, seq int, page int, text string")
    got = {r.label: r.value for r in records.labelled_fields(blocks, ["Effective date", "Policy owner"]).collect()}
    assert got == {"effective date": "July 1, 2026", "policy owner": "Finance"}
    c = spark.createDataFrame([("d", "title", None, "label", 1), ("d", "title", "T", "tab", 2), ("d", "title", "U", "pdf", 3)], "doc_id string, field string, value string, source string, priority int")
    assert records.by_priority(c).first().value == "T"


def test_names(spark):
    names = spark.createDataFrame([("UC", "University C", 1), ("University C", "University C", 0)], "name string, organization string, priority int")
    asked = spark.createDataFrame([("uc",), (" university c",), ("x",), (None,)], "name string")
    assert sorted((r.name or "", r.organization) for r in records.resolved_names(asked, names).collect()) == [("", None), (" university c", "University C"), ("uc", "University C"), ("x", None)]


def test_contracts_and_envelopes(spark):
    e = spark.createDataFrame([("a", "completed", "r", None), ("b", "completed", None, None), ("c", "failed", None, "e"), ("d", "queued", None, "e"), (None, "queued", None, None), ("f", "odd", None, None)], "job_id string, status string, result string, error string")
    good, refused = records.valid_events(e)
    assert sorted(r.job_id for r in good.collect()) == ["a", "c"] and refused.count() == 4
    s = spark.createDataFrame([("s1", [("q", 1)])], "session_id string, turns array<struct<text: string, n: int>>").select("session_id", F.struct("turns").alias("session"))
    stored = records.encode_sessions(s).unionByName(spark.createDataFrame([("s2", '{"format":"session","version":2,"session":{"turns":[]}}'), ("s3", "x")], "session_id string, body string"))
    back, refused = records.decode_sessions(stored, "struct<turns: array<struct<text: string, n: int>>>")
    assert [(r.session_id, r.session.turns[0].text) for r in back.collect()] == [("s1", "q")] and refused.count() == 2
