"""Behaviour of single operators on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.stemming import stem
from docquarry.operators import catalog, chunking, context, evaluate, fusion, jobs, layout, lexical, session, temporal


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("text, terms", [
    ("The 1,234,567 dollars, v2.1.3 of it.", ["1234567", "dollars", "v2.1.3"]),
    ("12,34 and 1,000.50", ["12", "34", "1000.50"]),
    ("", []),
])
def test_analyzer(spark, text, terms):
    assert one(spark, T.analyzed, text) == terms


@pytest.mark.parametrize("word, want", [("consignment", "consign"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("flies", "fli"), ("dying", "die"), ("skies", "sky"), ("policies", "polici"), ("generously", "generous"), ("proceed", "proceed"), ("feed", "feed"), ("agreed", "agre"), ("y", "y")])
def test_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("text, n", [("Don't stop.", 5), ("naïve café", 2), ("", 0), ("a_b -- 3.5", 6)])
def test_token_count(spark, text, n):
    assert one(spark, T.token_count, text) == n


def test_repairs(spark):
    r = one(spark, T.repaired, " e\ufb03cient \ufb02ow\u200bs\ue123 \u00a0x ")
    assert r.text == "efficient flows x" and r.repairs == ["ligature:\ufb02->fl", "ligature:\ufb03->ffi", "private_use_glyphs_removed"]
    assert one(spark, T.repaired, "\uf0b7 item").text == "\u2022 item"
    r = one(spark, T.font_repaired, "ExecuƟve aŌer")
    assert (r.text, r.n) == ("Executive after", 2)


@pytest.mark.parametrize("url, want", [("http://a/b?utm_x=1&c=2#f", "http://a/b?c=2#f"), ("http://a/b?utm_x=1", "http://a/b"), ("http://a/b", "http://a/b"), ("http://a/b?c=2&d", "http://a/b?c=2&d")])
def test_tracking(spark, url, want):
    assert one(spark, T.without_tracking, url) == want


def test_numbers(spark):
    assert one(spark, T.numbers, "1,000.00 and 007, 3.50; 0") == ["1000", "7", "3.50", "0"]


@pytest.mark.parametrize("number, parts, kind", [("3.2.1", ["3", "2", "1"], "decimal"), ("5.0", ["5"], "integer"), ("12.", ["12"], "integer"), ("PR1.2", ["PR1", "2"], "prefixed"), ("2054.517", None, None), ("x", None, None)])
def test_clause_numbers(spark, number, parts, kind):
    r = one(spark, T.clause_number, number)
    assert (r.parts, r.kind) == (parts, kind) if r else parts is None


@pytest.mark.parametrize("text, day", [("2026-07-01", dt.date(2026, 7, 1)), ("2026-07", None), ("2026", None), ("2026-13-01", None)])
def test_iso_days(spark, text, day):
    assert one(spark, T.iso_day, text) == day


def test_slug(spark):
    assert one(spark, T.slug, "Travel & Expense: Policy!") == "travel-expense-policy"
    assert one(spark, lambda c: T.slug(c, 10), "alpha beta gamma") == "alpha"


def test_keyword_query(spark):
    assert one(spark, T.keyword_query, "What is the (travel) policy, please?") == "travel policy"


@pytest.mark.parametrize("text, want", [("• item", "bullet"), ("1.2 Scope", "ordered"), ("(a) first", "ordered"), ("- x", "bullet"), ("-x", None), ("plain", None), ("iv. fourth", "ordered")])
def test_markers(spark, text, want):
    assert one(spark, T.list_marker, text) == want


def test_bm25_drops_zero_scores_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple pear"), (3, "plum")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "apple apple"), (8, "quince")], "query_id long, text string")
    got = lexical.top_k(lexical.scores(docs, asked), 5).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in got] == [(9, 1, 1), (9, 2, 2)]
    assert lexical.scores(docs.limit(0), asked).count() == 0


def test_rrf_ties(spark):
    schema = "query_id long, item_id long, rank long"
    a, b = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema), spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3)], schema)
    assert [r.item_id for r in fusion.rrf([a, b]).orderBy("rank").collect()] == [10, 11, 12]


def test_round_robin_uses_places_not_ranks(spark):
    runs = spark.createDataFrame([(1, 0, 100, 5), (1, 0, 101, 9), (1, 1, 200, 1), (1, 1, 100, 2)], "query_id long, intent int, item_id long, rank long")
    assert [(r.item_id, r.depth, r.intents) for r in fusion.round_robin(runs).orderBy("rank").collect()] == [(100, 1, "0,1"), (200, 1, "1"), (101, 2, "0")]


def test_associated_intents(spark):
    e = spark.createDataFrame([(1, 1, 0, 2.0), (1, 1, 1, -1.0), (1, 2, 0, -3.0), (1, 2, 1, -2.0), (1, 3, 0, None), (1, 3, 1, None)], "query_id long, item_id long, intent int, score double")
    assert rows(fusion.associated(e).select("item_id", "intent"), "item_id", "intent") == [(1, 0), (2, 1), (3, 0), (3, 1)]


VERSIONS = [(1, 7, dt.date(2020, 1, 1), dt.date(2021, 1, 1), False), (2, 7, dt.date(2021, 1, 1), None, True), (3, 8, dt.date(2020, 1, 1), None, True), (4, None, None, None, None), (5, 9, dt.date(2020, 1, 1), None, True), (6, 9, dt.date(2022, 1, 1), None, True)]


@pytest.fixture
def versions(spark):
    return spark.createDataFrame(VERSIONS, "doc_id long, series_id long, effective date, superseded date, is_current boolean")


def test_registry_keeps_series_of_two(versions):
    assert rows(temporal.registry(versions).select("doc_id", "place"), "doc_id") == [(1, 1), (2, 2), (5, 1), (6, 2)]


def test_superseded_day_is_exclusive(spark, versions):
    days = spark.createDataFrame([(dt.date(2021, 1, 1),)], "day date")
    assert rows(temporal.in_force(versions.filter("series_id = 7"), days).select("doc_id")) == [(2,)]


def test_month_names_a_version_first(spark, versions):
    months = spark.createDataFrame([(2021, 1), (2020, 6)], "year int, month int")
    assert rows(temporal.for_month(versions.filter("series_id = 7"), months).select("year", "doc_id"), "year") == [(2020, 1), (2021, 2)]


def test_current_must_be_one(versions):
    assert rows(temporal.current(versions.filter("series_id is not null")).select("series_id", "doc_id"), "series_id") == [(7, 2), (8, 3), (9, None)]


def test_stable_filter_keeps_order_and_drops_unselected_series(spark, versions):
    ranking = spark.createDataFrame([(1, d, d, r) for r, d in enumerate([6, 3, 1, 4, 2], 1)], "query_id long, item_id long, doc_id long, rank long")
    selected = spark.createDataFrame([(2,)], "doc_id long")
    got = temporal.stable_filter(ranking, temporal.registry(versions), selected).orderBy("kept_rank")
    assert [r.doc_id for r in got.collect()] == [3, 4, 2]


def test_clean_lines(spark):
    lines = []
    for p in range(1, 5):
        lines += [("d", p, 1, 10.0, 20.0, 8.0, "https://x"), ("d", p, 2, 40.0, 50.0, 11.0, "Running Header"), ("d", p, 3, 300.0, 310.0, 11.0, f"Body {p}"), ("d", p, 4, 760.0, 770.0, 11.0, f"Page {p + 2}")]
    lines += [("d", 1, 5, 60.0, 70.0, 11.0, "4"), ("d", 1, 6, 400.0, 410.0, 11.0, "")]
    df = spark.createDataFrame(lines, "doc_id string, page int, seq int, y0 double, y1 double, size double, text string")
    pages = spark.createDataFrame([("d", p, 792.0) for p in range(1, 5)], "doc_id string, page int, height double")
    got = {(r.page, r.seq): r.removed for r in layout.clean_lines(df, pages).collect()}
    assert [got[1, k] for k in range(1, 7)] == ["browser_header_footer", "repeated_boilerplate", None, "page_number", None, "icon_or_empty"]


def test_heading_runs(spark):
    b = spark.createDataFrame([("d", i, k, 12.0, 1.0) for i, k in enumerate(["heading"] * 3 + ["paragraph"] + ["heading"] * 2)], "doc_id string, seq int, kind string, size double, bold_ratio double")
    assert [r.demoted for r in layout.demote_heading_runs(b).orderBy("seq").collect()] == [True] * 3 + [False] * 3


def test_gaps(spark):
    i = spark.createDataFrame([("a", 0, 5), ("a", 1, 2), ("a", 7, 9), ("a", 9, 10), ("b", 3, 4)], "k string, start int, end int")
    assert rows(layout.gaps(i, ["k"])) == [("a", 5, 7)]


def test_xy_cut_reads_columns(spark):
    items = [("d", 1, 0, 50.0, 10.0, 500.0, 30.0), ("d", 1, 1, 50.0, 100.0, 250.0, 110.0), ("d", 1, 2, 300.0, 100.0, 500.0, 110.0), ("d", 1, 3, 50.0, 111.0, 250.0, 121.0), ("d", 1, 4, 300.0, 111.0, 500.0, 121.0)]
    df = spark.createDataFrame(items, "doc_id string, page long, item long, x0 double, y0 double, x1 double, y1 double")
    assert [r.item for r in layout.xy_cut(df).orderBy("place").collect()] == [0, 1, 3, 2, 4]


def test_body_style(spark):
    lines = [("d", 1, "x" * 50, 11.1, 0.0, 0.0, 100.0), ("d", 2, "y" * 20, 16.0, 1.0, 0.0, 200.0), ("d", 3, "z" * 50, 10.9, 0.0, 0.0, 90.0)]
    df = spark.createDataFrame(lines, "doc_id string, seq int, text string, size double, bold_ratio double, x0 double, x1 double")
    r = layout.body_size(df).first()
    assert (r.body_size, r.body_bold, r.line_width) == (11.0, False, 90.0)


def test_group_units_and_windows(spark):
    units = spark.createDataFrame([(1, 1, 0, 200), (1, 2, 0, 50), (1, 3, 0, 20), (1, 4, 1, 5), (1, 5, 1, 390), (1, 6, 1, 390)], "doc_id long, seq long, parent int, tokens long")
    assert [r.group for r in chunking.group_units(units).orderBy("seq").collect()] == [1, 1, 2, 3, 4, 5]
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "one, two")], "doc_id long, text string")
    assert rows(chunking.token_windows(docs, 2), "doc_id", "window") == [(1, 1, "a b"), (1, 2, "c d"), (1, 3, "e"), (3, 1, "one,"), (3, 2, "two")]


def test_sentences_keep_abbreviations(spark):
    text = "See e.g. Smith for this. Next one. U. T. Austin it is."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [text[r.start : r.end] for r in chunking.sentences(docs).orderBy("sentence").collect()] == ["See e.g. Smith for this.", "Next one.", "U. T. Austin it is."]


def test_tables(spark):
    df = spark.createDataFrame([([["Name", "Age"], ["Ann", "3"]],), ([["a", "b"]],), ([["N", ""], ["", "x"]],)], "t array<array<string>>")
    assert [r.q for r in df.select(chunking.table_quality(F.col("t")).alias("q")).collect()] == ["medium", "low", "low"]
    assert df.select(chunking.pipe_table(F.col("t")).alias("p")).first().p == "| Name | Age |\n| Ann | 3 |"


def test_context_skips_and_duplicates(spark):
    e = spark.createDataFrame([(1, 10, 1, 2000, "a"), (1, 11, 2, 600, "b"), (1, 12, 3, 2000, "a"), (1, 10, 4, 1, "a"), (1, 13, 5, 300, "c")], "query_id long, item_id long, rank long, tokens long, content_hash string")
    got = [(r.item_id, r.label, r.cost, r.reason) for r in context.assemble(e).orderBy("rank").collect()]
    assert got == [(10, "S1", 2000, None), (11, None, 600, "token budget"), (12, "S2", 0, None), (10, None, 0, "repeated chunk"), (13, "S3", 300, None)]


def test_gate_passes_without_scores(spark):
    e = spark.createDataFrame([(1, None), (2, -1.0), (3, 0.0)], "query_id long, score double")
    assert rows(context.gate(e).select("query_id", "passes"), "query_id") == [(1, True), (2, False), (3, True)]


def test_quotes_in_order(spark):
    df = spark.createDataFrame([(["ab", "bc"], "abc"), (["ab", "bc"], "ab bc"), (["bc", "ab"], "ab bc"), ([], "x")], "p array<string>, t string")
    assert [r.o for r in df.select(context.occurs_in_order(F.col("p"), F.col("t")).alias("o")).collect()] == [False, True, False, True]


def test_ungrounded_numbers(spark):
    df = spark.createDataFrame([("pay 1,000 or 7", "1000.00", "x")], "c string, a string, b string")
    assert df.select(context.ungrounded_numbers(F.col("c"), F.col("a"), F.col("b")).alias("u")).first().u == ["7"]


@pytest.mark.parametrize("text, kind", [("Thanks, that's all!", "suppress"), ("Thank you, what about meals?", "retrieve"), ("Give me that in two bullet points", "presentation"), ("What is", "wait"), ("I need the", "wait"), ("How much is the allowance…", "wait"), ("What are the limits?", "retrieve"), ("", "retrieve")])
def test_turn_gate(spark, text, kind):
    assert one(spark, session.turn_kind, text) == kind


def test_fragments(spark):
    t = spark.createDataFrame([(1, 0, "wait", "What is"), (1, 1, "retrieve", "the limit?"), (1, 2, "retrieve", "And meals?")], "conv_id long, turn long, kind string, text string")
    assert [r.utterance for r in session.fragments_joined(t).orderBy("turn").collect()] == ["What is", "What is the limit?", "And meals?"]


def test_jobs(spark):
    e = spark.createDataFrame([("j", 1, "queued"), ("j", 2, "processing"), ("j", 3, "processing"), ("j", 4, "queued")], "job string, at int, status string")
    assert [r.at for r in jobs.violations(e, "job", ["at"], "status").orderBy("at").collect()] == [3, 4]
    assert [r.at for r in jobs.without_repeats(e, "job", ["at"], "status").orderBy("at").collect()] == [1, 2, 4]


def test_named_queries_refuse_what_they_do_not_know(spark):
    docs = spark.createDataFrame([(i, "o", "k") for i in range(4)], "doc_id long, organization string, kind string")
    got, more = catalog.named_query(spark, "documents", {"documents": docs}, {"organization": "o"}, 3)
    assert [r.doc_id for r in got.collect()] == [0, 1, 2] and more
    with pytest.raises(ValueError):
        catalog.named_query(spark, "documents", {"documents": docs}, {"x": 1})
    with pytest.raises(ValueError):
        catalog.named_query(spark, "drop", {}, {})
    with pytest.raises(ValueError):
        catalog.named_query(spark, "documents", {"documents": docs}, {}, 501)


def test_chosen_values_prefer_chunks_even_if_null(spark):
    chunks = spark.createDataFrame([(1, None)], "d long, v string")
    manifest = spark.createDataFrame([(1, "m"), (2, "n")], "d long, v string")
    assert rows(catalog.chosen_values(chunks, manifest, "d", ["v"]), "d") == [(1, None, 1), (2, "n", 0)]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 9)], "case_id long, unit int, item_id long")
    ranking = spark.createDataFrame([(1, 5, 2), (1, 7, 1)], "case_id long, item_id long, rank long")
    r = {x.case_id: x for x in evaluate.case_metrics(evaluate.unit_ranks(gold, ranking)).collect()}
    assert (r[1].recall_1, r[1].recall_3, r[1].all_3, r[1].mrr_10) == (0.0, 0.5, False, 0.5)
    assert (r[2].recall_10, r[2].mrr_10) == (0.0, 0.0)
