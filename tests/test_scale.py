"""Whole results of the searches that are made in the tasks: short quotes, ties, several passes."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import outline, passages
from docquarry.operators import contained, evaluate, fusion, layout, lexical


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("sent", [contained.SENT_BYTES, 600])
def test_quotes_of_any_length_are_found(spark, monkeypatch, sent):
    monkeypatch.setattr(contained, "SENT_BYTES", sent)
    monkeypatch.setattr(contained, "PIECE", 64)
    rng = random.Random(3)
    texts = [(i, f"d{i % 3}", " ".join(rng.choice(["ab", "bc", "abc", "ñandú", "x1", "b"]) for _ in range(rng.randrange(60)))) for i in range(40)] + [(40, "d1", None), (41, "d2", "")]
    quotes = [t[a : a + n] for n in (1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 120) for _, _, t in texts[:6] for a in [rng.randrange(max(1, len(t) - n))]] + ["b a", "", "not there", "ab", "ab"]
    quotes = [(i, 0, "other", " ".join(q.split())) for i, q in enumerate(quotes)] + [(len(quotes), 0, "other", None)]
    found = evaluate.holders(spark.createDataFrame(quotes, "case_id long, unit int, doc_id string, quote string"), spark.createDataFrame(texts, "chunk_id long, doc_id string, text string"))
    want = sorted((q[0], t[0]) for q in quotes for t in texts if q[3] is not None and t[2] is not None and q[3] in t[2])
    assert rows(found, "case_id", "chunk_id") == want


def test_short_quotes_have_notices(spark):
    chunks = spark.createDataFrame([(1, "d", "the fee is due"), (2, "e", "a fee is  owed"), (3, "f", "coffee is hot")], "chunk_id long, doc_id string, text string")
    quotes = spark.createDataFrame([("k", 0, "d", "fee is")], "case_id string, unit int, doc_id string, quote string")
    gold, errors, notices = evaluate.benchmark(quotes, chunks)
    assert rows(gold, "chunk_id") == [(1,)] and errors.count() == 0 and rows(notices, "chunk_id") == [(2,), (3,)]


def test_equal_hashes_are_compared():
    quote = b"a" * 32 + b"x" + b"a" * 40
    finder = contained.Finder([quote, quote.replace(b"x", b"y")])
    data = np.frombuffer(quote + quote[5:], np.uint8)
    assert finder.find(data, np.array([len(quote), len(data)])).tolist() == [0]


@pytest.mark.parametrize("stem, sent, block", [(False, lexical.SENT_BYTES, lexical.BLOCK), (False, 30, 7), (True, lexical.SENT_BYTES, 7)])
def test_best_texts_are_those_of_all_scores(spark, monkeypatch, stem, sent, block):
    monkeypatch.setattr(lexical, "SENT_BYTES", sent)
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(5)
    words = "travel travels traveling limit limits fee the 1,000 a.b per".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, *((100 + i, t) for i, t in texts), (300, None), (None, "travel")], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "travel limits"), (2, "fees and a fee of 1000"), (3, ""), (4, "a.b per per travel")], "query_id long, text string")
    index, stats = lexical.build_index(docs)
    index = lexical.stemmed_postings(index) if stem else index
    # an id of null counts as a text, and has no score
    every = lexical.search(index, stats, asked, stem=stem).filter("doc_id IS NOT NULL")
    assert rows(lexical.scores(docs, asked, stem=stem), "query_id", "doc_id", "score") == rows(every, "query_id", "doc_id", "score")
    kept = []
    best = lexical.best(docs, asked, 3, stem=stem, kept=kept)
    assert rows(lexical.top_k(best, 3), "query_id", "doc_id", "score", "rank") == rows(lexical.top_k(every, 3), "query_id", "doc_id", "score", "rank")
    back = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc()))
    assert rows(best.withColumn("r", back).filter("r <= 3"), "query_id", "doc_id", "r") == rows(every.withColumn("r", back).filter("r <= 3"), "query_id", "doc_id", "r")
    [df.unpersist() for df in kept]


def test_texts_of_one_id_are_one_text(spark):
    docs = spark.createDataFrame([(1, "fee"), (1, "limit limit"), (2, "fee limit limit")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fee limit")], "query_id long, text string")
    got = rows(lexical.scores(docs, asked), "doc_id", "score")
    assert [x[0] for x in got] == [1, 2] and got[0][1] == got[1][1]


@pytest.mark.parametrize("block, sent", [(fusion.BLOCK, fusion.SENT_BYTES), (10, 64)])
def test_dense_search_in_blocks_is_the_whole_search(spark, monkeypatch, block, sent):
    monkeypatch.setattr(fusion, "BLOCK", block)
    monkeypatch.setattr(fusion, "SENT_BYTES", sent)
    rng = np.random.default_rng(1)
    data = rng.integers(-2, 3, (80, 3)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(90, None)], "vec_id long, embedding array<float>").repartition(3)
    queries = vectors.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    want = [(q, i, float(s), r) for q in range(0, 80, 10) for r, (s, i) in enumerate(sorted(((data[q] @ data[i], i) for i in range(80)), key=lambda x: (-x[0], x[1]))[:7], 1)]
    assert rows(fusion.dense_top_k(vectors, queries, 7), "query_id", "vec_id", "score", "rank") == sorted(want)
    assert fusion.dense_top_k(vectors.filter("vec_id < 3"), queries, 7).count() == 24 and fusion.dense_top_k(vectors, queries.filter("query_id < 0"), 7).count() == 0


def test_a_task_makes_few_scores_at_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(fusion, "BLOCK", 100)
    monkeypatch.setattr(np, "round", lambda x, n, was=np.round: (made.append(x.size), was(x, n))[1])
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda df, run, kind: df.sparkSession.createDataFrame(pa.Table.from_batches(run(df.toArrow().to_batches()))))
    assert fusion.dense_top_k(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 2).count() == 100 and max(made) <= 100


def test_only_texts_that_may_be_boilerplate_are_counted(spark):
    lines = spark.createDataFrame([("d", p, s, y, y + 10, 11.0, t) for p in range(1, 5) for s, y, t in ((1, 20.0, "Report of Ö"), (2, 40.0, str(10 + p)), (3, 60.0, "ab!"), (4, 400.0, "Report of Ö"))], "doc_id string, page long, seq int, y0 double, y1 double, size double, text string")
    heights = lines.select("doc_id", "page", F.lit(800.0).alias("height")).distinct()
    cleaned = layout.clean_lines(lines, heights)
    assert rows(cleaned.groupBy("seq").agg(F.max("removed").alias("r"), F.count("removed").alias("n")), "seq", "r", "n") == [(1, "repeated_boilerplate", 4), (2, "page_number", 4), (3, None, 0), (4, None, 0)]
    # a line that can't be boilerplate has no key that it would be counted or joined by
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "spread" in plan


def test_blocks_of_a_document_are_counted_once(monkeypatch):
    counted = []
    monkeypatch.setattr(passages, "TOKEN", type("Token", (), {"findall": staticmethod(lambda t, was=passages.TOKEN: (counted.append(len(t)), was.findall(t))[1])}))
    passages._counted.cache_clear()
    rng = random.Random(2)
    blocks = [outline.Block(block_id=str(i), kind="list_item" if i % 5 == 0 else "paragraph", text=" ".join(rng.choice(["fee", "ñ,", "(x)", "limits."]) for _ in range(rng.randrange(1, 90))), number=f"1.{i}" if i % 5 == 0 else None) for i in range(200)]
    chunks, _ = passages.chunk_document("d", blocks, "Title", "Org")
    assert sum(counted) < 4 * sum(len(b.text) for b in blocks)
    assert all(c["tokens"] == len(re.findall(r"\w+|[^\w\s]", c["text"])) and c["retrieval_tokens"] == len(re.findall(r"\w+|[^\w\s]", c["retrieval_text"])) for c in chunks)
