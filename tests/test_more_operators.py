"""Sources, dates, questions of several parts, iteration and streams."""


import pytest
from pyspark.sql import functions as F

from docquarry.functions import dates
from docquarry.operators import iterate, multi
from docquarry.sources import files
from docquarry.streaming import jobs, sessions


def test_scan_files(spark, tmp_path):
    for name in ("a/Travel Policy.pdf", "b/Travel Policy.PDF", "c/note.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    got = files.scan_files(spark, str(tmp_path)).orderBy("relative_path").collect()
    assert [r.relative_path for r in got] == ["a/Travel Policy.pdf", "b/Travel Policy.PDF"]
    assert all(r.doc_id.startswith("travel-policy-") and r.size == len(r.relative_path) for r in got)
    assert len({r.doc_id for r in got}) == 2


def test_records_and_tables(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.json").write_text('{"doc_id":\n "d1", "n": 1}')
    (tmp_path / "docs/_manifest.json").write_text('{"doc_id": "m"}')
    assert [r.doc_id for r in files.read_json(spark, str(tmp_path / "docs"), "doc_id string, n int").collect()] == ["d1"]
    chunks = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "doc_id string, ordinal int, retrievable boolean")
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks"), "doc_id string, ordinal int, retrievable boolean", excluded=True).first().ordinal == 2
    (tmp_path / "a.toml").write_text('[aliases]\nUC = "University C"\n')
    assert [tuple(r) for r in files.toml_table(spark, str(tmp_path / "a.toml"), "aliases").collect()] == [("UC", "University C")]


def test_index_and_loads(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "h1"), ("c2", "h2")], "chunk_id string, content_hash string")
    files.check_index(chunks, chunks)
    with pytest.raises(ValueError):
        files.check_index(chunks, chunks.withColumn("content_hash", F.lit("x")))
    for n in (1, 2):
        loads = files.load_tables(chunks.limit(n), chunks, str(tmp_path), n)
    assert loads.count() == 2 and files.current_table(spark, str(tmp_path), "documents").count() == 2


@pytest.mark.parametrize("text, kind, n", [
    ("What changed between July 1, 2024 and 2026-07-01?", "compare", 2), ("as of 7/1/2026", "point_in_time", 1), ("in July 2026", "point_in_time", 1),
    ("what is the latest rule", "current", 0), ("in 2026", "neutral", 0), ("July 2026 or july 2026", "point_in_time", 1), ("13/45/2026", "neutral", 0), ("", "neutral", 0),
])
def test_temporal_intent(spark, text, kind, n):
    r = spark.createDataFrame([(text,)], "t string").select(dates.temporal_intent("t").alias("i")).first().i
    assert (r.kind, len(r.dates)) == (kind, n)


def test_dates_in_texts():
    assert dates.text_dates("on 1 July 2026, 2025-03, March 4th, 2024 and 5/6/2023") == [(2023, 5, 6), (2024, 3, 4), (2025, 3, None), (2026, 7, 1)]
    assert dates.text_dates("July 4") == []


def test_unsupported_dates(spark):
    df = spark.createDataFrame([("July 2026 and 2025-01-02", "2026-07-01, 2025-01-03")], "a string, b string")
    made = df.select(dates.dates_in("a").alias("a"), dates.dates_in("b").alias("b")).select(dates.unsupported_dates(F.col("a"), F.col("b")).alias("u")).first().u
    assert [(d.year, d.month, d.day) for d in made] == [(2025, 1, 2)]


def test_comparison_form(spark):
    df = spark.createDataFrame([("“Busi­ness‑only”  o • ＳＥＧＭＥＮＴ",), (None,)], "t string")
    assert [r.f for r in df.select(dates.comparison_form("t").alias("f")).collect()] == ['"business-only" segment', None]


@pytest.mark.parametrize("question, parts", [
    ("What is the limit, and when must I file?", ["What is the limit?", "when must I file?"]),
    ("What is the limit and the deadline?", ["What is the limit and the deadline?"]),
    ("How much is it for meals; who signs the form?", ["How much is it for meals?", "who signs the form?"]),
    ("What is the fee, and how often is that paid?", ["What is the fee, and how often is that paid?"]),
    ("Is a card required at Delft, and is a receipt needed there?", ["Is a card required at Delft?", "is a receipt needed there?"]),
    ("What is the rule? Why?", ["What is the rule? Why?"]),
    ("What is the rule? Which forms do I need?", ["What is the rule?", "Which forms do I need?"]),
    ("How did the rule change from 2024-01-01 to 2025-01-01, and what is the fee?", ["How did the rule change from 2024-01-01 to 2025-01-01, and what is the fee?"]),
    ("Tell me about meals.", ["Tell me about meals."]),
])
def test_parts(question, parts):
    assert multi.parts_of(question) == parts


def test_mentions(spark):
    names = spark.createDataFrame([("Kyoto University", "Kyoto University", False), ("Delft", "University of Delft", True), ("Turin", "University of Turin", True)], "name string, organization string, exact boolean")
    asked = spark.createDataFrame([(1, "At Delft's office and kyoto university?"), (2, "delft or Turinese"), (3, None)], "query_id long, text string")
    got = {r.query_id: r.organizations for r in multi.mentioned(asked, names).collect()}
    assert got == {1: ["University of Delft", "Kyoto University"], 2: [], 3: []}
    assert multi.outside("At Padua University, what is Delft University like?", ["Delft"]) == ["Padua University"]


def test_carry_and_strategy(spark):
    i = spark.createDataFrame([(1, 0, ["A"]), (1, 1, []), (2, 0, ["A"]), (2, 1, ["B"]), (2, 2, [])], "query_id long, intent long, organizations array<string>")
    got = {(r.query_id, r.intent): (r.carried, r.ambiguous) for r in multi.carry(i).collect()}
    assert got[1, 1] == (["A"], False) and got[2, 2] == ([], True) and got[1, 0] == ([], False)
    rows = [(1, 0, True, True, False, True), (2, 0, True, False, False, True), (2, 1, True, True, False, True), (3, 0, True, False, False, True), (3, 1, False, False, False, True), (4, 0, False, False, False, True), (4, 1, False, False, False, True), (5, 0, False, False, True, True), (5, 1, False, False, False, True), (6, 0, True, False, False, False), (6, 1, True, True, False, True)]
    f = spark.createDataFrame(rows, "query_id long, intent long, admissible boolean, covered boolean, blocked boolean, same boolean")
    assert {r.query_id: r.strategy for r in multi.strategy(f).collect()} == {1: "delegate", 2: "fused", 3: "fused", 4: "delegate", 5: "no_supported_intent", 6: "per_intent"}


def test_decompose_frame(spark):
    asked = spark.createDataFrame([(1, "What is the limit, and when must I file?"), (2, None)], "query_id long, text string")
    assert [(r.query_id, r.intent) for r in multi.decompose(asked).orderBy("query_id", "intent").collect()] == [(1, 0), (1, 1), (2, 0)]


def test_iteration_stops_and_merges(spark, tmp_path):
    def write(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def retrieve(asked):
        score = F.when(F.col("text") == "good question", 1.0).when(F.col("text") == "travel limit", 0.5).otherwise(-1.0)
        return asked.select("query_id", (F.length("text") * 10).cast("long").alias("item_id"), F.lit(1).cast("long").alias("rank"), score.alias("score"))

    asked = spark.createDataFrame([(1, "good question"), (2, "What is the travel limit?"), (3, "of the")], "query_id long, text string")
    merged, trace = iterate.iterate(asked, retrieve, write)
    assert [(r.query_id, r.score) for r in merged.filter("merged_rank = 1").orderBy("query_id").collect()] == [(1, 1.0), (2, 0.5), (3, -1.0)]
    assert sorted((r.query_id, r.round, r.decision) for r in trace.collect()) == [(1, 0, "sufficient"), (2, 0, "insufficient"), (2, 1, "sufficient"), (3, 0, "insufficient")]


def test_job_stream(spark, tmp_path):
    def batch(rows, name):
        spark.createDataFrame(rows, "job_id string, seq long, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    batch([("a", 1, "queued"), ("a", 2, "processing"), ("b", 1, "processing")], "1")
    batch([("a", 3, "processing"), ("a", 4, "completed"), ("a", 5, "queued")], "2")
    stream = spark.readStream.schema("job_id string, seq long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.lifecycle(stream).writeStream.format("memory").queryName("job_stream").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.job_id, r.seq, r.before, r.accepted) for r in spark.table("job_stream").collect())
    assert got == [("a", 1, None, True), ("a", 2, "queued", True), ("a", 4, "processing", True), ("a", 5, "completed", False), ("b", 1, None, False)]


def test_session_stream(spark, tmp_path):
    rows = [(1, 0, "What is the limit?"), (1, 1, "And what about the"), (1, 2, "meals?"), (1, 3, "Thanks!")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = sessions.turns(stream).writeStream.format("memory").queryName("turn_stream").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.kind, r.utterance, r.context_turn) for r in spark.table("turn_stream").orderBy("turn").collect()]
    assert got == [("retrieve", "What is the limit?", None), ("wait", "And what about the", 0), ("retrieve", "And what about the meals?", 0), ("suppress", "Thanks!", 2)]
