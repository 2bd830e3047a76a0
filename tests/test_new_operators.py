"""Operators on tables: chunks, pages, versions, answers, sessions, catalog, jobs, evaluation and sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions.intents import Directory
from docquarry.operators import catalog, chunking, clauses, dialogue, evaluate, fusion, iterate, jobs, lexical, multi, pages, records, verify
from docquarry.sources import files


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_chunks_of_block_tables(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [("a", 1, "heading", "Title", None, 1), ("a", 2, "list_item", f"1.1 {long}", "1.1", None), ("a", 3, "list_item", f"1.2 {long}", "1.2", None), ("b", 1, "paragraph", "", None, None), (None, 1, "paragraph", "text", None, None)]
    blocks = spark.createDataFrame(rows, "doc_id string, seq long, kind string, text string, number string, level int").withColumns({"clause": F.lit("x"), "path": F.lit(1)})
    chunks = clauses.chunk_documents(blocks)
    assert rows_of(chunks, "doc_id", "clause_id") == [("a", "1.1"), ("a", "1.2"), (None, None)]
    assert clauses.coverage_problems(chunks.filter("doc_id = 'a'"), spark.createDataFrame([("2",), ("9",)], "block_id string")).collect()[0].code == "block_not_chunked"
    assert clauses.chunk_documents(blocks.limit(0)).count() == 0 and clauses.chunk_diagnostics(blocks).filter("doc_id = 'a'").count() == 0


def test_groups_follow_the_limits(spark):
    units = [(1, 120, "content"), (2, 120, "content"), (3, 90, "content"), (4, 20, "content"), (5, 150, "heading"), (6, 10, "heading"), (7, 0, "heading"), (8, 300, "heading"), (9, 500, "content")]
    df = spark.createDataFrame([("d", s, 0, t, k) for s, t, k in units], "doc_id string, seq long, parent int, tokens long, kind string")
    assert [r.group for r in chunking.group_units(df).orderBy("seq").collect()] == [1, 2, 2, 2, 3, 3, 4, 5, 6]


def test_lines_and_blocks_of_tables(spark):
    spans = [("d", 1, i, 0, 50.0, y, 50.0 + 6 * len(t), y + 10, "Arial", 10.0, 0, [(c, 6.0) for c in t]) for i, (t, y) in enumerate([("Title of it", 10.0), ("Some text here.", 60.0), ("Some text here.", 61.0)])]
    schema = "doc_id string, page int, piece int, span int, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, chars array<struct<c: string, w: double>>"
    lines = pages.lines_of_pages(spark.createDataFrame(spans, schema))
    assert rows_of(lines, "text", "removed") == [("Some text here.", "duplicate_render"), ("Some text here.", None), ("Title of it", None)]
    styled = lines.withColumns({"body_size": F.lit(8.0), "body_bold": F.lit(False), "line_width": F.lit(300.0), "page_width": F.lit(600.0), "page_height": F.lit(800.0), "excluded": F.array(F.struct(F.lit("title of it").alias("title"), F.lit("old").alias("reason")))})
    assert rows_of(pages.blocks_of_documents(styled), "kind", "text", "retrievable") == [("heading", "Title of it", False), ("paragraph", "Some text here.", False)]
    assert rows_of(pages.weighted(spark.createDataFrame([("d", 1, "ab", 1.0, 0.0, 0.0, 5.0, 5.0), ("d", 1, "cd", 0.0, 2.0, 2.0, 9.0, 9.0)], "doc_id string, block int, text string, bold double, x0 double, y0 double, x1 double, y1 double"), "bold"), "x1", "bold") == [(9.0, 0.5)]


def test_dense_top_k_equals_brute_force(spark):
    r = np.random.default_rng(5)
    data = r.normal(size=(300, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(5)
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(x.query_id, x.rank): x.vec_id for x in fusion.dense_top_k(vectors, asked, 4).collect()}
    want = {}
    for q in range(0, 300, 50):
        scores = np.round(data.astype(np.float64) @ data[q].astype(np.float64), 6)
        for k, i in enumerate(sorted(range(300), key=lambda i: (-scores[i], i))[:4], 1):
            want[q, k] = i
    assert got == want and fusion.dense_top_k(vectors, asked.limit(0), 4).count() == 0


def test_models_are_batched_and_made_once(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(99, None)], "item_id long, text string").coalesce(1)

    def load():
        return lambda batch: [[float(len(t)), 1.0] for t in batch] if len(batch) <= 16 else 1 / 0

    got = {r.item_id: r.embedding for r in fusion.embedded(texts, load, "p: ").collect()}
    assert len(got) == 41 and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    pairs = texts.selectExpr("1 AS query_id", "item_id", "'q' AS query", "text")
    assert fusion.pair_scores(pairs, lambda: lambda batch: [len(t or "") for _, t in batch]).filter("score = 0").count() == 1


def test_associated_keeps_ties_and_unknowns(spark):
    e = spark.createDataFrame([(1, 1, 0, -1.0), (1, 1, 1, -1.0), (1, 1, 2, -2.0), (1, 2, 0, 1.0), (1, 2, 1, -1.0), (1, 3, 0, None), (1, 3, 1, -5.0)], "query_id int, item_id int, intent int, score double")
    assert rows_of(fusion.associated(e), "item_id", "intent") == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]


def test_index_equals_search_of_texts(spark):
    docs = spark.createDataFrame([(1, "travel limits of 1,000 dollars"), (2, "limits limits"), (3, ""), (4, None), (5, "traveling")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "travel limit"), (8, "limits 1000"), (9, "")], "query_id long, text string")
    index, stats = lexical.build_index(docs)
    direct, indexed = lexical.scores(docs, asked), lexical.search(index, stats, asked)
    assert rows_of(direct, "query_id", "doc_id", "score") == rows_of(indexed, "query_id", "doc_id", "score") and direct.count() == 3
    assert {(r.query_id, r.doc_id) for r in lexical.scores(docs, asked, stem=True).collect()} == {(7, 1), (7, 2), (7, 5), (8, 1), (8, 2)}
    assert lexical.scores(docs.limit(0), asked).count() == 0


def test_refinements_and_promotion(spark):
    d = Directory(["A University", "B University"], {})
    asked = spark.createDataFrame([(1, "What is the limit at A University and B University?", ["A University", "B University"]), (2, "Limits in July 2026 please", [])], "query_id long, text string, organizations array<string>")
    cover = spark.createDataFrame([(1, "insufficient", ["B University"]), (2, "insufficient", [])], "query_id long, decision string, gaps array<string>")
    made = iterate.refinements(asked, cover, multi.stripped(d))
    assert rows_of(made, "query_id", "strategy", "text")[0][2] == "limit University B University"
    taken, skipped = iterate.next_queries(made, asked, spark.createDataFrame([(1, "x")], "query_id long, identity string"))
    assert rows_of(taken, "query_id", "text") == [(1, "What is the limit at and B University (B University)"), (2, "Limits July 2026")] and skipped.count() == 0
    ranked = spark.createDataFrame([(1, i, "B University" if i == 9 else "A University", 1.0 if i < 10 else -1.0, i) for i in range(1, 12)], "query_id long, item_id long, organization string, score double, rank long")
    got = [r.item_id for r in iterate.promote(ranked, asked, 10).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5, 9, 6, 7, 8, 10]


def test_iteration_with_organizations(spark, tmp_path):
    def write(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def retrieve(asked):
        b = F.col("text").contains("(B)")
        return asked.select("query_id", F.when(b, 2).otherwise(1).cast("long").alias("item_id"), F.lit(1).cast("long").alias("rank"), F.lit(1.0).alias("score"), F.when(b, "B").otherwise("A").alias("organization"))

    asked = spark.createDataFrame([(1, "What of it", ["A", "B"], [], False), (2, "Of Q only", [], ["Q College"], False)], "query_id long, text string, organizations array<string>, outside array<string>, unavailable boolean")
    merged, trace = iterate.iterate(asked, retrieve, write)
    assert rows_of(trace, "query_id", "round", "reason", "stop") == [(1, 0, "organization_gap", None), (1, 1, "relevant", "sufficient"), (2, 0, "outside_only", "structural")]
    assert rows_of(merged, "query_id", "item_id") == [(1, 1), (1, 2), (2, 1)]


def test_aligned_rankings_and_intents(spark):
    d = Directory(["Rutgers University"], {"Rutgers": "Rutgers University"})
    asked = spark.createDataFrame([(1, "What may a Travel Card buy?"), (2, "What is due?")], "query_id long, text string")
    rows = [(q, i, i, None, t) for q in (1, 2) for i, t in enumerate(["The PCard rules", "General rules", "A TCard is used"], 1)]
    schema = "query_id long, item_id long, rank int, organization string, text string"
    got = multi.aligned(spark.createDataFrame(rows, schema), spark.createDataFrame(rows + [(1, 4, 4, None, "travel cards")], schema), asked, d, 3)
    assert [r.item_id for r in got.filter("query_id = 1").orderBy("rank").collect()] == [3, 4, 2] and got.filter("query_id = 2").count() == 3
    made = multi.intents(spark.createDataFrame([(1, "What are the rules at Rutgers, and when are receipts due?"), (2, None)], "query_id long, text string"), d)
    assert rows_of(made, "query_id", "intent", "carried") == [(1, 0, []), (1, 1, ["Rutgers University"]), (2, 0, [])]
    none = multi.unsupported(spark.createDataFrame([(1, 0, "a?", ["Q College"]), (1, 1, "b?", [])], "query_id long, intent int, text string, outside array<string>"))
    assert none.first().gaps == ["Part 1 (a?): this part names an organization outside the corpus (Q College)", "Part 2 (b?): no relevant evidence was retrieved for this part"]
    answers = spark.createDataFrame([(1, "s", "ungrounded_output", 2, 2), (2, "s", "ungrounded_output", 2, 1), (3, None, "ungrounded_output", 1, 1), (4, "s", None, 0, 0)], "query_id int, series string, abstention string, n_problems int, n_version_problems int")
    assert [r.strategy for r in multi.split_decision(answers).orderBy("query_id").collect()] == ["split_by_version", "single", "single", "single"]


def test_judged_tables(spark):
    answers = spark.createDataFrame([(1, '{"status": "answered", "claims": [{"text": "Meals cost 40.", "sources": ["S1"], "quotes": ["limited to 40 dollars"]}]}'), (2, None)], "answer_id long, body string")
    sources = spark.createDataFrame([(1, "S1", "Meals are limited to 40 dollars.", "", "d", None, None, None)], "answer_id long, label string, text string, meta string, doc_id string, series_id string, effective string, superseded string")
    asked = spark.createDataFrame([(1, "Cost?", {"s": ["d"]})], "answer_id long, question string, asked map<string, array<string>>")
    got = verify.judged(answers, sources, asked)
    assert rows_of(got, "answer_id", "accepted") == [(1, True), (2, False)] and got.filter("answer_id = 2").first().problems[0].code == "not_json"


def test_sessions(spark, tmp_path):
    d = Directory(["U"], {})
    turns = [(1, 0, "What is the limit at U in July 2026?", "retrieve"), (1, 1, "thanks", "suppress"), (1, 2, "Does it apply to staff?", "retrieve"), (1, 3, "Actually, staff abroad.", "retrieve"), (2, 0, None, "retrieve")]
    got = dialogue.read_turns(spark.createDataFrame(turns, "conv_id long, turn long, text string, kind string"), d)
    assert rows_of(got, "conv_id", "turn", "kind") == [(1, 0, "self_contained"), (1, 2, "follow_up"), (1, 3, "refinement"), (2, 0, "self_contained")]
    store = dialogue.SessionStore(str(tmp_path), "x int")
    sessions = lambda *rows: spark.createDataFrame(list(rows), "session_id string, body string")
    store.put(sessions(("a", "1"), ("b", "1")), 0)
    store.put(sessions(("a", "2")), 1)
    store.delete(sessions(("b", None)), 2)
    assert rows_of(store.sessions(spark), "session_id", "body") == [("a", "2")] and store.get(spark, sessions(("z", None))).count() == 0
    store.compact(spark, 3)
    assert rows_of(store.sessions(spark), "session_id", "body") == [("a", "2")]


def test_merged_answers(spark):
    claims = "answer_id long, claim int, text string, sources array<string>"
    old = spark.createDataFrame([(1, 0, "The meal limit is 40 dollars", ["a"]), (1, 1, "Receipts must be kept", ["b"]), (1, 2, "Old rule here", ["c"])], claims)
    new = spark.createDataFrame([(1, 0, "The meal limit is 50 dollars", ["d"]), (2, 0, "Alone", ["d"])], claims)
    chunks = spark.createDataFrame([("a", "s", "1"), ("b", None, "2"), ("c", "s", "9"), ("d", "s", "1")], "item_id string, series_id string, doc_id string")
    chosen = spark.createDataFrame([(1, "s", ["1"])], "answer_id long, series_id string, doc_ids array<string>")
    got = dialogue.merged_answers(old, new, chunks, chosen)
    assert rows_of(got.filter("place IS NOT NULL"), "answer_id", "place", "origin") == [(1, 0, "replaces"), (1, 1, "kept"), (2, 0, "new")]
    assert rows_of(got.filter("place IS NULL"), "origin", "text")[0][0] == "dropped"


def test_worker_and_delivery(spark):
    requests = spark.createDataFrame([("1", "s", "q"), ("1", "s", "q"), ("2", "s", ""), (None, "s", "q"), ("3", "s", "q")], "job_id string, session_id string, question string")
    finished = spark.createDataFrame([("3", "completed", "r", None)], "job_id string, status string, result string, error string")
    events, done, rejected = jobs.work(requests, finished, lambda asked: asked.selectExpr("job_id", "'r' AS result", "CAST(NULL AS STRING) AS error"))
    assert rows_of(events, "job_id", "seq", "status") == [("1", 0, "processing"), ("1", 1, "completed"), ("2", 1, "failed"), ("3", 1, "completed")]
    assert done.count() == 3 and rejected.count() == 1
    messages = spark.createDataFrame([("q", i, "bad" if i == 2 else "ok") for i in range(1, 4)], "queue string, seq long, body string")
    assert rows_of(jobs.deliver(messages, lambda m: 1 / 0 if m["body"] == "bad" else None), "seq", "outcome") == [(1, "handled"), (2, "rejected"), (3, "handled")]


@pytest.mark.parametrize("tool, given", [("x", {}), ("document_search", {}), ("document_search", {"query": ""}), ("document_search", {"query": "a", "limit": 99}), ("document_search", {"query": "a", "as_of": "2026-13-01"}), ("metadata_lookup", {"chunk_id": "c", "doc_id": "d"}), ("metadata_query", {"name": 3}), ("metadata_lookup", {"sql": "1"})])
def test_tool_inputs_are_checked(tool, given):
    with pytest.raises(ValueError):
        catalog.checked_input(tool, given)
    assert catalog.checked_input("document_search", {"query": "a", "limit": 5, "doc_id": None}) == {"query": "a", "limit": 5}


def test_catalog(spark):
    docs = spark.createDataFrame([("a-1", "A", "x", True), ("a-2", "A", "y", None), ("b-1", None, "x", False)], "doc_id string, organization string, domain string, is_current boolean")
    assert [r.doc_id for r in catalog.named_query(spark, "documents", {"documents": docs}, {"domain": "x", "is_current": True})[0].collect()] == ["a-1"]
    assert catalog.the_one(docs, "b") == "b-1" and catalog.the_one(docs, "-2") == "a-2"
    for text in ("a", "zz"):
        with pytest.raises(ValueError):
            catalog.the_one(docs, text)
    ranking = spark.createDataFrame([(1, 1, "c1", "a-1", "A", True, "2020-01-01", None), (1, 2, "c2", "a-2", "A", None, "2020", None), (1, 3, "c3", "b-1", None, False, "2020-01-01", "2021-01-01"), (2, 1, "c3", "b-1", None, False, None, None)], "query_id int, rank int, chunk_id string, doc_id string, organization string, is_current boolean, effective_date string, superseded_date string")
    results, notes = catalog.document_search(ranking, current_only=True, as_of="2022-01-01")
    assert rows_of(results, "chunk_id", "applies") == [("c1", "in_force"), ("c2", "undetermined")] and rows_of(notes, "query_id") == [(1,), (2,)]


def test_sources(spark, tmp_path):
    settings = tmp_path / "s.toml"
    settings.write_text('[documents."a.pdf"]\nprofile = "generic"\n')
    found, unknown = files.overrides_of(spark.createDataFrame([("a.pdf",), ("b.pdf",)], "filename string"), files.toml_table(spark, str(settings), "documents"))
    assert rows_of(found, "filename", "settings") == [("a.pdf", '{"profile": "generic"}'), ("b.pdf", None)] and unknown.count() == 0
    chunks = spark.createDataFrame([("c", "h")], "chunk_id string, content_hash string")
    files.save_index(spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<float>"), chunks, f"{tmp_path}/i", "m")
    assert files.load_index(spark, f"{tmp_path}/i", chunks, "m").count() == 1
    for model, now in (("other", chunks), ("m", spark.createDataFrame([("c", "g")], chunks.schema))):
        with pytest.raises(ValueError):
            files.load_index(spark, f"{tmp_path}/i", now, model)
    ran = []
    assert files.migrate(spark, {"1_a": "A", "2_b": "B"}, f"{tmp_path}/m", ran.append) == ["1_a", "2_b"] and files.migrate(spark, {"1_a": "A", "2_b": "B", "3_c": "C"}, f"{tmp_path}/m", ran.append) == ["3_c"]
    assert ran == ["A", "B", "C"]
    for bad in ({"1_a": "X", "2_b": "B", "3_c": "C"}, {"1_a": "A", "3_c": "C"}):
        with pytest.raises(ValueError):
            files.migrate(spark, bad, f"{tmp_path}/m", ran.append)
    paths = spark.createDataFrame([("x/Café Rules.pdf",)], "p string").select(files.document_key(F.col("p")).alias("k"))
    assert paths.first().k.startswith("cafe-rules-")
    with pytest.raises(ValueError):
        files.guard_snapshot(spark.createDataFrame([("a", "1")], "path string, hash string"), spark.createDataFrame([("a", "2")], "path string, hash string"))


def test_reports_and_benchmarks(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    assert evaluate.report("R", {"T": df}, 1) == "# R\n\n## T\n\n| n | t |\n|---|---|\n| 1 | a/b |\n(1 rows more)\n"
    chunks = spark.createDataFrame([("c1", "d", "one two  three four five six"), ("c2", "d", "seven"), ("c3", "e", "zero one two three four five six seven")], "chunk_id string, doc_id string, text string")
    quotes = spark.createDataFrame([("k", 0, "d", "one two three four five six"), ("l", 0, "d", "nowhere")], "case_id string, unit int, doc_id string, quote string")
    gold, errors, notices = evaluate.benchmark(quotes, chunks)
    assert rows_of(gold, "chunk_id") == [("c1",)] and rows_of(errors, "case_id", "n") == [("l", 0)] and rows_of(notices, "chunk_id") == [("c3",)]
    units = spark.createDataFrame([("a", 0, None, True, None, False), ("a", 1, 3, False, 12, False), ("b", 0, 1, False, 1, True)], "case_id string, unit int, pool_rank int, dropped boolean, rerank_rank int, in_context boolean")
    expected = spark.createDataFrame([("a", "answer", "answer", None), ("b", "answer", "abstain", "low_relevance"), ("c", "abstain", "answer", None)], "case_id string, expect string, status string, abstention string")
    assert rows_of(evaluate.first_failures(evaluate.gold_failures(units, expected)), "case_id", "primary_stage") == [("a", "temporal"), ("b", "reranking"), ("c", "generation")]


@pytest.mark.parametrize("text, want", [("July 1, 2026.", "2026-07-01"), ("july 1 2026", "2026-07-01"), ("July, 2026", "2026-07"), ("7/2026", "2026-07"), ("", None)])
def test_more_date_formats(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(records.normalized_date(F.col("t")).alias("d")).first().d == want


def test_document_fields_requests_and_waiting(spark):
    blocks = spark.createDataFrame([("d", 1, 1, "paragraph", "Effective date: July 1, 2026", 10.0), ("d", 2, 1, "heading", "Rules", 20.0)], "doc_id string, seq int, page int, kind string, text string, size double").withColumn("tab_title", F.lit("Rules | Some College"))
    assert rows_of(records.document_fields(blocks), "field", "value", "normalized") == [("effective_date", "July 1, 2026", "2026-07-01"), ("organization", "Some College", None), ("title", "Rules", None)]
    good, refused = records.valid_requests(spark.createDataFrame([("1", "s", "q"), ("2", "s", " "), (None, "s", "q"), ("3", None, "q")], "job_id string, session_id string, question string"))
    assert good.count() == 1 and rows_of(refused, "reason") == [("no_job",), ("no_question",), ("no_session",)]
    last = spark.createDataFrame([("1", "completed"), ("2", "processing")], "job_id string, status string")
    assert jobs.wait(lambda: last, "1", 1) == "completed" and jobs.wait(lambda: last, "2", 0.1, 0.05) is None
    lines = spark.createDataFrame([("d", {"a": 2}, [], None), ("d", None, ["private_use_glyphs_removed"], "duplicate_render")], "doc_id string, repairs map<string, int>, notes array<string>, removed string")
    assert rows_of(pages.repair_warnings(lines), "code", "n") == [("duplicate_render", 1), ("icon_glyphs", 1), ("text_repaired", 2)] and rows_of(pages.removal_counts(lines), "n") == [(1,)]
