"""The queries of the engine's operators on the driver's tables, each with the same query in SQL.

Documents stand for chunks (their lines for blocks, source for the organization), benchmark rows for questions, orders
for versions of a customer's document, events for job events, conversations for sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import dates
from docquarry.functions import text as T
from docquarry.functions.dialogue import CLAIM_STOP
from docquarry.operators import catalog, chunking, clauses, context, dialogue, evaluate, fusion, iterate, jobs, layout, lexical, multi, pages, session, temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def long(c: Column) -> Column:
    return c.cast("long")


def plain_words(text: Column) -> Column:
    """A second analyzer: runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


# --- SQL fragments --------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_ANALYZE = r"regexp_extract_all(regexp_replace(regexp_replace(lower(text), '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{3})\b', '\1\2', 'g'), '[a-z0-9]+(?:\.[a-z0-9]+)*')"
_PLAIN = r"regexp_extract_all(lower(text), '\p{L}+')"


def _bm25(analyze: str, stop: bool, prefix: str = "") -> str:
    where = f"WHERE term NOT IN ({_STOP})" if stop else ""
    p = prefix
    return f"""{p}terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({analyze}) AS term FROM documents) {where} GROUP BY doc_id, term),
{p}asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({analyze}) AS term FROM benchmark) {where} GROUP BY query_id, term),
{p}len AS (SELECT doc_id, sum(tf) AS dl FROM {p}terms GROUP BY doc_id),
{p}n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM {p}len) AS total),
{p}idf AS (SELECT term, count(*) AS df, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {p}terms, {p}n GROUP BY term),
{p}scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / (total / n)))), 6) AS score
  FROM {p}terms JOIN {p}asked USING (term) JOIN {p}idf USING (term) JOIN {p}len USING (doc_id), {p}n GROUP BY query_id, doc_id),
{p}ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}scored WHERE score > 0)"""


_VERSIONS = """versions AS (SELECT o_orderkey AS doc_id, o_custkey AS series_id, CAST(o_orderdate AS DATE) AS effective,
  lead(CAST(o_orderdate AS DATE)) OVER w AS superseded, lead(o_orderkey) OVER w IS NULL AS is_current
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents)"
_FUSED = f"""{_bm25(_ANALYZE, True, 'a_')}, {_bm25(_PLAIN, False, 'b_')},
every AS (SELECT query_id, doc_id AS item_id, rank FROM a_ranked WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, rank FROM b_ranked WHERE rank <= 100),
fused AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM every GROUP BY query_id, item_id),
fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, item_id) AS rank FROM fused)"""


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the versions of a document: each is in force until the next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("date").alias("effective"), F.lead(F.col("o_orderdate").cast("date")).over(w).alias("superseded"), F.lead("o_orderkey").over(w).isNull().alias("is_current"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, seq (from 1), text: the lines of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select("doc_id", "source", long(F.col("at") + 1).alias("seq"), "text")


#: Rows of rankings that are made once and sent to the tasks at most; they follow the number of questions, not of texts.
SENT_ROWS = 1 << 18


def held(make: Callable[[list | None], DataFrame], most: int) -> DataFrame:
    """A ranking of few rows, made once, as queries read it several times, and sent to where texts are read; one that may
    have more rows stays a plan. make gets a list for what is kept until the ranking is made, or None."""
    if most > SENT_ROWS:
        return make(None)
    ranking = make(kept := [])
    try:
        return F.broadcast(ranking.sparkSession.createDataFrame(ranking.toArrow(), ranking.schema))
    finally:
        for df in kept:
            df.unpersist()


def bm25_ranking(spark: SparkSession, sf_dir: str, k: int, analyzer=T.analyzed, stem: bool = False) -> DataFrame:
    asked = questions_of(spark, sf_dir)
    return held(lambda kept: lexical.top_k(lexical.best(docs_of(spark, sf_dir), asked, k, analyzer, stem, kept=kept), k), asked.count() * k)


def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (bm25_ranking(spark, sf_dir, 100, f).withColumnRenamed("doc_id", "item_id") for f in (T.analyzed, plain_words))
    return fusion.rrf([a, b])


# --- lexical and dense retrieval, fusion ----------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_ANALYZE}) AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY doc_id, term")
def analyze_terms(spark, d):
    return lexical.postings(docs_of(spark, d))


@query(f"WITH {_bm25(_ANALYZE, True)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index_stats(spark, d):
    docs = docs_of(spark, d)
    return lexical.inverse_frequencies(lexical.postings(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25(_ANALYZE, True)} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm25_ranking(spark, d, 10)


@query()
def bm25_stemmed_topk(spark, d):
    return bm25_ranking(spark, d, 10, stem=True)


@query("SELECT doc_id, CAST(strpos(lower(text), 'the of') AS BIGINT) AS at FROM documents WHERE strpos(lower(text), 'the of') > 0")
def phrase_find(spark, d):
    return lexical.find_phrase(docs_of(spark, d), "the of").select("doc_id", "at")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS wanted FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], wanted::DOUBLE[]), 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return fusion.dense_top_k(vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query(f"WITH {_FUSED} SELECT query_id, item_id, score, best_rank, rank FROM fused_ranked WHERE rank <= 20")
def rrf_fusion(spark, d):
    return fused_ranking(spark, d).filter("rank <= 20")


_RERANKED = f"""{_FUSED}, pool AS (SELECT query_id, item_id, rank AS before FROM fused_ranked WHERE rank <= 20),
dt AS (SELECT DISTINCT doc_id AS item_id, term FROM a_terms WHERE doc_id IN (SELECT item_id FROM pool)), nd AS (SELECT item_id, count(*) AS n FROM dt GROUP BY item_id),
nq AS (SELECT query_id, count(*) AS n FROM a_asked GROUP BY query_id),
k AS (SELECT query_id, item_id, count(*) AS k FROM pool JOIN a_asked USING (query_id) JOIN dt USING (item_id, term) GROUP BY query_id, item_id),
rs AS (SELECT query_id, item_id, before, round(coalesce(k, 0)::DOUBLE / (nd.n + nq.n - coalesce(k, 0)), 6) AS score FROM pool JOIN nd USING (item_id) JOIN nq USING (query_id) LEFT JOIN k USING (query_id, item_id)),
reranked AS (SELECT query_id, item_id, before, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM rs)"""


def reranked(spark, d) -> DataFrame:
    """The fused pool by a stand-in scorer, the similarity of term sets."""
    docs, asked = docs_of(spark, d), questions_of(spark, d)

    def scorer(pairs: DataFrame) -> DataFrame:
        # texts are cut into terms after the join, so that only those of the pool are
        texts = pairs.join(docs.withColumnRenamed("doc_id", "item_id"), "item_id")
        texts = texts.join(asked.withColumnRenamed("text", "question"), "query_id").select("query_id", "item_id", T.analyzed(F.col("text")).alias("x"), T.analyzed(F.col("question")).alias("y"))
        return texts.select("query_id", "item_id", F.round(fusion.jaccard_of(F.col("x"), F.col("y")), 6).alias("score"))

    pool = held(lambda _: fused_ranking(spark, d).filter(F.col("rank") <= fusion.POOL), asked.count() * fusion.POOL)
    return fusion.rerank(pool, scorer)


@query(f"WITH {_RERANKED} SELECT query_id, item_id, before, score, rank FROM reranked")
def hybrid_pool_rerank(spark, d):
    return reranked(spark, d).select("query_id", "item_id", "before", "score", "rank")


@query(f"WITH {_RERANKED} SELECT query_id, count(*) FILTER (rank < before) AS up, count(*) FILTER (rank > before) AS down, count(*) FILTER (rank = before) AS unchanged FROM reranked GROUP BY query_id")
def rank_movement(spark, d):
    return evaluate.movement(reranked(spark, d).select("query_id", F.col("before").alias("r0"), F.col("rank").alias("r1")))


# --- versions -------------------------------------------------------------------------------------------------------


@query(f"WITH {_VERSIONS}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM versions) SELECT series_id, doc_id, effective, superseded, is_current, row_number() OVER (PARTITION BY series_id ORDER BY effective, doc_id) AS place FROM c WHERE n >= 2")
def version_registry(spark, d):
    return temporal.registry(versions_of(spark, d)).select("series_id", "doc_id", "effective", "superseded", "is_current", "place")


_DAYS = ("1996-06-30", "1998-01-01", "2000-12-31")


@query(f"WITH {_VERSIONS}, days AS (SELECT unnest([{', '.join(f'DATE {x!r}' for x in _DAYS)}]) AS day) SELECT series_id, day, doc_id FROM versions JOIN days ON effective <= day AND (superseded IS NULL OR day < superseded)")
def asof_in_force(spark, d):
    days = spark.createDataFrame([(x,) for x in _DAYS], "day string").select(F.col("day").cast("date").alias("day"))
    return temporal.in_force(versions_of(spark, d), days)


@query(f"""WITH {_VERSIONS}, months AS (SELECT * FROM (VALUES (1996, 7), (1999, 2)) AS m(year, month)),
named AS (SELECT series_id, year, month, doc_id FROM versions JOIN months ON year(effective) = year AND month(effective) = month)
SELECT series_id, year::BIGINT AS year, month::BIGINT AS month, doc_id FROM named UNION ALL
SELECT series_id, year::BIGINT, month::BIGINT, doc_id FROM versions JOIN months ON effective <= make_date(year, month, 1) AND (superseded IS NULL OR make_date(year, month, 1) < superseded)
WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.series_id = versions.series_id AND n.year = months.year AND n.month = months.month)""")
def version_for_month(spark, d):
    months = spark.createDataFrame([(1996, 7), (1999, 2)], "year int, month int")
    return temporal.for_month(versions_of(spark, d), months).select("series_id", long(F.col("year")).alias("year"), long(F.col("month")).alias("month"), "doc_id")


@query(f"WITH {_VERSIONS} SELECT series_id, CASE WHEN count(*) FILTER (is_current) = 1 THEN max(CASE WHEN is_current THEN doc_id END) END AS doc_id, count(*) FILTER (is_current) AS n_current FROM versions GROUP BY series_id")
def current_version(spark, d):
    return temporal.current(versions_of(spark, d))


_PRICE_RANK = "ranking AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS item_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


def price_ranking(spark, d) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    orders = table(spark, d, "orders").withColumn("query_id", F.col("o_custkey") % 50)
    return orders.select("query_id", F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("doc_id"), long(F.row_number().over(w)).alias("rank"))


@query(f"""WITH {_VERSIONS}, {_PRICE_RANK}, reg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM versions) WHERE n >= 2),
chosen AS (SELECT doc_id FROM reg WHERE effective <= DATE '1998-01-01' AND (superseded IS NULL OR DATE '1998-01-01' < superseded)),
kept AS (SELECT * FROM ranking WHERE doc_id NOT IN (SELECT doc_id FROM reg WHERE doc_id NOT IN (SELECT doc_id FROM chosen)))
SELECT query_id, item_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept_rank FROM kept""")
def temporal_stable_filter(spark, d):
    reg = temporal.registry(versions_of(spark, d))
    chosen = reg.filter(temporal.covers(F.lit("1998-01-01").cast("date"))).select("doc_id")
    return temporal.stable_filter(price_ranking(spark, d), reg, chosen).select("query_id", "item_id", "rank", "kept_rank")


@query(f"WITH {_VERSIONS} SELECT doc_id, CASE WHEN effective IS NULL THEN 'undetermined' WHEN effective <= DATE '1998-01-01' AND (superseded IS NULL OR DATE '1998-01-01' < superseded) THEN 'in_force' ELSE 'not_in_force' END AS status FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE effective END AS effective, superseded FROM versions)")
def asof_applicability(spark, d):
    v = versions_of(spark, d).withColumn("effective", F.when(F.col("doc_id") % 7 != 0, F.col("effective")))
    return v.select("doc_id", temporal.applicability(F.lit("1998-01-01").cast("date")).alias("status"))


@query(f"WITH {_VERSIONS}, reg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM versions) WHERE n >= 2) SELECT series_id, string_agg(doc_id::VARCHAR, ',' ORDER BY effective, doc_id) AS doc_ids FROM reg GROUP BY series_id")
def series_versions(spark, d):
    reg = temporal.registry(versions_of(spark, d))
    return reg.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("doc_ids"))


# --- text -----------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS n_tokens FROM documents")
def token_counts(spark, d):
    return docs_of(spark, d).select("doc_id", long(T.token_count(F.col("text"))).alias("n_tokens"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS hash FROM documents")
def text_normal_form(spark, d):
    return docs_of(spark, d).select("doc_id", T.content_hash(T.normal_form(F.col("text"))).alias("hash"))


_LIGATED = ", ".join(f"CASE WHEN contains(text, '{a}') THEN 'ligature:{a}->{b}' END" for a, b in T.LIGATURES.items())


def _replaced(inner: str) -> str:
    for a, b in T.LIGATURES.items():
        inner = f"replace({inner}, '{a}', '{b}')"
    return inner


@query(f"""WITH t AS (SELECT doc_id, replace(replace(text, 'fi', 'ﬁ'), 'e ', 'e ​ ') AS text FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(replace(replace({_replaced('text')}, chr(8203), ''), chr(160), ' '), ' {{2,}}', ' ', 'g'), ' ')) AS hash, array_to_string(list_filter([{_LIGATED}], lambda x: x IS NOT NULL), ',') AS repairs FROM t""")
def normalize_repairs(spark, d):
    t = docs_of(spark, d).withColumn("text", F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("e "), F.lit("e ​ ")))
    r = t.select("doc_id", T.repaired(F.col("text")).alias("r"))
    return r.select("doc_id", T.content_hash(F.col("r.text")).alias("hash"), F.array_join("r.repairs", ",").alias("repairs"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '\?', '?utm_source=a&') AS url FROM pages),
p AS (SELECT page_id, split_part(url, '#', 1) AS head, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#')) ELSE '' END AS rest FROM u),
q AS (SELECT page_id, split_part(head, '?', 1) AS base, rest, CASE WHEN contains(head, '?') THEN array_to_string(list_filter(string_split(substr(head, strpos(head, '?') + 1), '&'), lambda x: NOT starts_with(x, 'utm_')), '&') ELSE '' END AS kept FROM p)
SELECT page_id, base || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || rest AS url FROM q""")
def strip_tracking(spark, d):
    u = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"\?", "?utm_source=a&").alias("url"))
    return u.select("page_id", T.without_tracking(F.col("url")).alias("url"))


@query(r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x:
  CASE WHEN regexp_full_match(regexp_replace(replace(x, ',', ''), '^(\d+)\.0+$', '\1'), '\d+') THEN CASE WHEN ltrim(regexp_replace(replace(x, ',', ''), '^(\d+)\.0+$', '\1'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(replace(x, ',', ''), '^(\d+)\.0+$', '\1'), '0') END ELSE replace(x, ',', '') END))), ';'), '') AS numbers FROM documents""")
def numbers_found(spark, d):
    return docs_of(spark, d).select("doc_id", F.array_join(F.sort_array(T.numbers(F.col("text"))), ";").alias("numbers"))


_SLUG = "trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT item_id, CASE WHEN length({_SLUG}) <= 48 THEN {_SLUG} WHEN contains(substr({_SLUG}, 1, 48), '-') THEN regexp_replace(substr({_SLUG}, 1, 48), '-[^-]*$', '') ELSE substr({_SLUG}, 1, 48) END || '-' || substr(sha256(text), 1, 6) AS doc_key FROM benchmark")
def stable_ids(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.concat(T.slug(F.col("text")), F.lit("-"), F.substring(F.sha2("text", 256), 1, 6)).alias("doc_key"))


# --- lines, blocks and chunks ---------------------------------------------------------------------------------------


@query(f"""WITH {_LINES}, p AS (SELECT *, (seq - 1) * 14.0 AS y0, (seq - 1) * 14.0 + 11.0 AS y1, count(*) OVER (PARTITION BY doc_id) * 14.0 AS height FROM lines), n AS (SELECT source, count(DISTINCT doc_id) AS n FROM lines GROUP BY source),
z AS (SELECT source, doc_id, seq, lower(text) AS key, CAST(floor(y0 / 4.0) AS BIGINT) AS bucket FROM p WHERE text <> '' AND (y1 <= 0.12 * height OR y0 >= 0.8 * height) AND NOT regexp_matches(text, '(?i)^(page\\s*)?\\d{{1,4}}(\\s*(of|/)\\s*\\d{{1,4}})?$')),
c AS (SELECT a.source, a.doc_id, a.seq, a.key, count(DISTINCT b.doc_id) AS on_pages FROM z a JOIN z b ON b.source = a.source AND b.key = a.key AND b.bucket BETWEEN a.bucket - 1 AND a.bucket + 1 GROUP BY ALL)
SELECT source AS doc_id, doc_id AS page, seq FROM c JOIN n USING (source) WHERE n >= 3 AND on_pages >= greatest(3, ceil(0.5 * n)) AND length(regexp_replace(key, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 4""")
def repeated_boilerplate(spark, d):
    y0 = (F.col("seq") - 1) * 14.0
    lines = lines_of(spark, d).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "seq", "text", y0.alias("y0"), (y0 + 11.0).alias("y1"), F.lit(11.0).alias("size"))
    height = lines.groupBy("doc_id", "page").agg((F.count("*") * 14.0).alias("height"))
    return layout.clean_lines(lines, height).filter("removed = 'repeated_boilerplate'").select("doc_id", "page", "seq")


@query("WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) - l_linenumber AS off FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, off) AS n FROM c) SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, q::VARCHAR AS text FROM n WHERE n >= 2")
def page_number_sequence(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), long(F.col("l_linenumber")).alias("page"), F.lit(1).alias("seq"), long(F.col("l_quantity")).cast("string").alias("text"), F.lit(40.0).alias("y0"), F.lit(51.0).alias("y1"), F.lit(11.0).alias("size"))
    heights = lines.select("doc_id", "page", F.lit(800.0).alias("height")).distinct()
    return layout.clean_lines(lines, heights).filter("removed = 'page_number'").select("doc_id", "page", "text")


_BLOCKS = f"""{_LINES}, blocks AS (SELECT doc_id, seq, text, CASE WHEN length(text) <= 160 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 25 AND NOT regexp_matches(text, '[.;,]$') AND length(regexp_replace(text, '\\P{{L}}', '', 'g')) >= 2 THEN 'heading' ELSE 'paragraph' END AS kind FROM lines)"""


def blocks_of(spark, d) -> DataFrame:
    """Lines as blocks of body size, so that those that look like headings count as bold ones."""
    b = lines_of(spark, d).withColumns({"size": F.lit(11.0), "body_size": F.lit(11.0), "bold_ratio": F.lit(1.0), "body_bold": F.lit(False), "line_count": F.lit(1)})
    like = (F.length("text") <= 160) & (F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")) <= 25) & ~F.col("text").rlike("[.;,]$") & (F.length(F.regexp_replace("text", r"\P{L}", "")) >= 2)
    return b.withColumn("kind", F.when(like, "heading").otherwise("paragraph"))


_MARKED = r"""CASE WHEN regexp_matches(text, '^([•◦▪▫●○■□‣⁃∙·*].|[-–]\s)') THEN 'bullet' WHEN regexp_matches(text, '^(\d{1,4}(\.\d{1,3})+\.?\s.|\d{1,3}[.)]\s.|\(\d{1,3}\).|\(?[ivxlc]{1,5}[.)]\s.|\(?[a-z][.)]\s.|[A-Z]{1,3}\d{1,3}(\.\d{1,3})*\.?\s.)') THEN 'ordered' END"""


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, seq, text, {_MARKED} AS marker, seq = 1 AS large FROM lines),
k AS (SELECT doc_id, seq, CASE WHEN length(text) <= 160 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 25 AND NOT regexp_matches(text, '[.;,]$') AND length(regexp_replace(text, '\\P{{L}}', '', 'g')) >= 2 AND coalesce(marker, '') <> 'bullet' AND (large OR (length(text) <= 120 AND NOT regexp_matches(text, ':$'))) THEN 'heading' WHEN marker IS NOT NULL THEN 'list_item' ELSE 'paragraph' END AS kind, marker FROM m)
SELECT doc_id, seq, kind, CASE WHEN kind = 'list_item' THEN marker END AS list_type FROM k""")
def classify_lines(spark, d):
    b = lines_of(spark, d).withColumns({"size": F.when(F.col("seq") == 1, 14.0).otherwise(11.0), "body_size": F.lit(11.0), "bold_ratio": F.lit(1.0), "body_bold": F.lit(False), "line_count": F.lit(1)})
    return layout.classify(b).select("doc_id", "seq", "kind", "list_type")


@query(f"""WITH {_BLOCKS}, r AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM blocks)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r) SELECT doc_id, seq, kind = 'heading' AND n >= 3 AS demoted FROM n""")
def heading_runs(spark, d):
    return layout.demote_heading_runs(blocks_of(spark, d)).select("doc_id", "seq", "demoted")


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value) * 1000) AS BIGINT) * 1000 AS e FROM events),
g AS (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i) SELECT user_id, reach AS gap_start, s AS gap_end FROM g WHERE s > reach""")
def interval_gaps(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    i = table(spark, d, "events").select("user_id", us.alias("start"), (us + long(F.floor(F.abs("value") * 1000)) * 1000).alias("end"))
    return layout.gaps(i, ["user_id"])


@query(f"""WITH {_BLOCKS}, h AS (SELECT doc_id, seq, length(text) % 5 AS size, regexp_matches(text, '^[A-Z]') AS bold, upper(text) = text AS caps FROM blocks WHERE kind = 'heading'),
l AS (SELECT *, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC, bold DESC, caps DESC)) AS level FROM h)
SELECT doc_id, seq, level, (SELECT max(p.seq) FROM l p WHERE p.doc_id = l.doc_id AND p.seq < l.seq AND p.level < l.level) AS parent_seq FROM l""")
def section_levels(spark, d):
    h = blocks_of(spark, d).filter("kind = 'heading'").select("doc_id", "seq", (F.length("text") % 5).alias("size"), F.col("text").rlike("^[A-Z]").alias("bold"), (F.upper("text") == F.col("text")).alias("caps"))
    return layout.section_parents(layout.heading_levels(h)).select("doc_id", "seq", "level", "parent_seq")


@query(f"WITH {_LINES}, c AS (SELECT doc_id, seq, doc_id || '::' || seq AS chunk_id FROM lines) SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def chunk_links(spark, d):
    c = lines_of(spark, d).withColumn("chunk_id", F.concat_ws("::", "doc_id", "seq"))
    return chunking.linked(c).select("chunk_id", "prev_id", "next_id")


_UNITS = f"""{_LINES}, units AS (SELECT doc_id, seq, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) AS tokens FROM lines)"""


@query(f"""WITH RECURSIVE {_UNITS}, walk(doc_id, seq, tokens, total, grp) AS (SELECT doc_id, seq, tokens, tokens, 1::BIGINT FROM units WHERE seq = 1
  UNION ALL SELECT u.doc_id, u.seq, u.tokens, CASE WHEN w.total + u.tokens <= 256 AND least(w.tokens, u.tokens) < 100 THEN w.total + u.tokens ELSE u.tokens END, CASE WHEN w.total + u.tokens <= 256 AND least(w.tokens, u.tokens) < 100 THEN w.grp ELSE w.grp + 1 END FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.seq = w.seq + 1)
SELECT doc_id, grp AS "group", min(seq) AS first_seq, max(seq) AS last_seq, sum(tokens)::BIGINT AS tokens FROM walk GROUP BY doc_id, grp""")
def chunk_group_greedy(spark, d):
    units = lines_of(spark, d).select("doc_id", "seq", F.lit(0).alias("parent"), long(T.token_count(F.col("text"))).alias("tokens"))
    return chunking.group_units(units).groupBy("doc_id", "group").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("tokens").alias("tokens"))


@query()
def token_windows(spark, d):
    return chunking.token_windows(docs_of(spark, d), chunking.TARGET).select("doc_id", "window", T.content_hash(F.col("text")).alias("hash"))


@query()
def sentence_spans(spark, d):
    return chunking.sentences(docs_of(spark, d))


@query(f"WITH {_LINES}, m AS (SELECT doc_id, seq, CASE WHEN length(text) < 30 THEN 'short' WHEN length(text) > 300 THEN 'long' END AS reason FROM lines), p AS (SELECT *, seq // 10 AS page FROM m WHERE reason IS NOT NULL), i AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, reason, page ORDER BY seq) AS island FROM p) SELECT doc_id, reason, page, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM i GROUP BY doc_id, reason, page, island")
def excluded_islands(spark, d):
    m = lines_of(spark, d).withColumn("reason", F.when(F.length("text") < 30, "short").when(F.length("text") > 300, "long")).withColumn("page", F.floor(F.col("seq") / 10))
    return chunking.excluded_runs(m)


@query("SELECT sha256(text) AS content_hash, count(*) AS n, count(DISTINCT source) AS n_docs, count(DISTINCT source) > 1 AS across FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_hashes(spark, d):
    return evaluate.repeated_texts(table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.sha2("text", 256).alias("content_hash")))


_DOC_TOKENS = "t AS (SELECT len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]')) AS tokens FROM documents)"


@query(f"WITH {_DOC_TOKENS} SELECT CASE {' '.join(f'WHEN tokens <= {b} THEN {b}' for b in evaluate.BINS)} END::BIGINT AS bin, count(*) AS n FROM t GROUP BY ALL")
def chunk_stats_bins(spark, d):
    t = table(spark, d, "documents").select(T.token_count(F.col("text")).alias("tokens"))
    return evaluate.size_bins(t).select(long(F.col("bin")).alias("bin"), "n")


@query(f"WITH {_DOC_TOKENS}, p AS (SELECT tokens, row_number() OVER (ORDER BY tokens) - 1 AS place, count(*) OVER () AS n FROM t) SELECT share, tokens FROM p, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.95, 1.0])::DOUBLE AS share) WHERE place = round_even(share * (n - 1), 0)")
def chunk_size_quantiles(spark, d):
    t = table(spark, d, "documents").select(long(T.token_count(F.col("text"))).alias("tokens"))
    return evaluate.size_quantiles(t)


@query("WITH t AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, n_chars FROM t WHERE place = floor(0.95::DOUBLE * (n - 1))")
def index_percentile(spark, d):
    return evaluate.index_percentile(table(spark, d, "documents"), "n_chars", 0.95, ["source"])


@query(f"""WITH {_BLOCKS}, f AS (SELECT doc_id, seq, kind, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ')) END AS n FROM cells),
w AS (SELECT *, list_distinct(string_split(t, ' ')) AS w FROM f),
hit AS (SELECT DISTINCT a.doc_id, a.seq FROM w a JOIN w h ON h.doc_id = a.doc_id AND h.seq > a.seq AND h.kind = 'heading' AND h.t <> '' WHERE a.kind <> 'heading' AND a.n <= 16 AND length(a.t) >= 3
  AND (a.t = h.t OR (least(length(a.t), length(h.t)) >= 8 AND least(length(a.t), length(h.t)) >= 0.6 * greatest(length(a.t), length(h.t)) AND (starts_with(a.t, h.t) OR starts_with(h.t, a.t))) OR len(list_intersect(a.w, h.w)) >= 0.75 * len(list_distinct(list_concat(a.w, h.w))))),
m AS (SELECT w.doc_id, w.seq, hit.seq IS NOT NULL AS e, kind <> 'heading' AND n <= 16 AS short FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.seq = w.seq),
g AS (SELECT *, e OR (short AND coalesce(lag(e) OVER o, false) AND coalesce(lead(e) OVER o, false)) AS inside FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
r AS (SELECT doc_id, seq, e, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM g WHERE inside), c AS (SELECT *, count(*) FILTER (e) OVER (PARTITION BY doc_id, run) AS hits FROM r)
SELECT doc_id, seq FROM c WHERE hits >= 3""".replace("FROM cells", "FROM (SELECT doc_id, seq, text, CASE WHEN kind = 'heading' AND seq % 2 = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM blocks)"))
def toc_jaccard(spark, d):
    b = blocks_of(spark, d).select("doc_id", "seq", "text", F.when((F.col("kind") == "heading") & (F.col("seq") % 2 == 0), "heading").otherwise("paragraph").alias("kind"))
    return clauses.navigation_blocks(b)


# --- context, claims and intents ------------------------------------------------------------------------------------

_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]'))"
_EVIDENCE = f"""{_bm25(_ANALYZE, True)}, evidence AS (SELECT query_id, doc_id AS item_id, rank, score, {_TOKENS} AS tokens, sha256(text) AS hash, source, d.doc_id FROM ranked JOIN documents d USING (doc_id) WHERE rank <= 10)"""


def evidence_of(spark, d) -> DataFrame:
    # what is made of texts is made after the join, so that it is made of ranked ones only
    own = table(spark, d, "documents").select("doc_id", "source", "text").join(bm25_ranking(spark, d, 10), "doc_id")
    return own.withColumns({"tokens": long(T.token_count(F.col("text"))), "content_hash": T.content_hash(F.col("text")), "item_id": F.col("doc_id")})


@query(f"""WITH RECURSIVE {_EVIDENCE}, walk(query_id, rank, item_id, label, cost, reason, n, used, hashes) AS (
  SELECT query_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, 0, 0::BIGINT, []::VARCHAR[] FROM (SELECT DISTINCT query_id FROM evidence)
  UNION ALL SELECT query_id, rank, item_id, CASE WHEN reason IS NULL THEN 'S' || (n + 1) END, cost, reason, CASE WHEN reason IS NULL THEN n + 1 ELSE n END, CASE WHEN reason IS NULL THEN used + cost ELSE used END, CASE WHEN reason IS NULL THEN list_append(hashes, hash) ELSE hashes END
  FROM (SELECT *, CASE WHEN n >= 6 THEN 'source limit' WHEN used + cost > 2400 THEN 'token budget' END AS reason FROM (SELECT w.query_id, e.rank, e.item_id, e.hash, w.n, w.used, w.hashes, CASE WHEN list_contains(w.hashes, e.hash) THEN 0 ELSE e.tokens END AS cost FROM walk w JOIN evidence e ON e.query_id = w.query_id AND e.rank = w.rank + 1)))
SELECT query_id, item_id, rank, label, cost, reason FROM walk WHERE rank > 0""")
def context_assembly(spark, d):
    return context.assemble(evidence_of(spark, d).select("query_id", "item_id", "rank", "tokens", "content_hash"))


@query(f"WITH {_EVIDENCE}, p AS (SELECT query_id, source AS series_id, doc_id, string_agg('S' || rank, ',' ORDER BY rank) AS labels FROM evidence GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY query_id, series_id) AS docs FROM p) SELECT query_id, series_id, doc_id, labels, row_number() OVER (PARTITION BY query_id, series_id ORDER BY doc_id) AS place FROM g WHERE docs >= 2")
def version_groups(spark, d):
    s = evidence_of(spark, d).select("query_id", F.col("source").alias("series_id"), "doc_id", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"), F.lit(None).cast("date").alias("effective"))
    return context.version_groups(s)


@query(f"WITH {_EVIDENCE}, s AS (SELECT query_id, score - 12 AS score FROM evidence) SELECT query_id, count(*) AS n, round(max(score), 6) AS best, count(*) >= 1 AND (max(score) IS NULL OR max(score) >= 0) AS passes FROM s GROUP BY query_id")
def sufficiency_gate(spark, d):
    return context.gate(evidence_of(spark, d).select("query_id", (F.col("score") - 12).alias("score"))).withColumn("best", F.round("best", 6))


_USES = "uses AS (SELECT o_custkey AS answer_id, o_orderkey AS claim, p AS position, 'S' || ((o_orderkey * (p + 3)) % 7) AS label FROM orders, (SELECT unnest([1, 2]) AS p))"


@query(f"""WITH {_USES}, f AS (SELECT answer_id, label, min({{'c': claim, 'p': position}}) AS first FROM uses GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first, label) AS number FROM f)
SELECT answer_id, label, claim, CAST(position AS BIGINT) AS position, number FROM uses JOIN n USING (answer_id, label)""")
def citation_numbers(spark, d):
    o = table(spark, d, "orders").withColumn("position", F.explode(F.array(F.lit(1), F.lit(2))))
    uses = o.select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("claim"), long(F.col("position")).alias("position"), F.concat(F.lit("S"), ((F.col("o_orderkey") * (F.col("position") + 3)) % 7).cast("string")).alias("label"))
    return context.number_citations(uses).select("answer_id", "label", "claim", "position", "number")


@query(f"""WITH {_bm25(_ANALYZE, True)}, p AS (SELECT query_id, doc_id, list_filter(list_transform(string_split(b.text, '.'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS passages, trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')) AS text FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)
SELECT query_id, doc_id, regexp_matches(text, array_to_string(passages, '.*')) AS occurs FROM p""")
def quote_occurs(spark, d):
    quotes = questions_of(spark, d).select("query_id", F.filter(F.transform(F.split("text", r"\."), T.normal_form), lambda x: x != "").alias("passages"))
    texts = docs_of(spark, d).join(bm25_ranking(spark, d, 10), "doc_id").select("query_id", "doc_id", T.normal_form(F.col("text")).alias("text"))
    return texts.join(quotes, "query_id").select("query_id", "doc_id", context.occurs_in_order(F.col("passages"), F.col("text")).alias("occurs"))


_CANONICAL = r"""list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)*'), lambda x: CASE WHEN regexp_full_match(regexp_replace(replace(x, ',', ''), '^(\d+)\.0+$', '\1'), '\d+')
  THEN CASE WHEN ltrim(regexp_replace(replace(x, ',', ''), '^(\d+)\.0+$', '\1'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(replace(x, ',', ''), '^(\d+)\.0+$', '\1'), '0') END ELSE replace(x, ',', '') END)"""


@query(f"""WITH {_bm25(_ANALYZE, True)}, p AS (SELECT query_id, doc_id, list_distinct({_CANONICAL.format('d.text')}) AS claimed, {_CANONICAL.format('b.text')} AS allowed FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)
SELECT query_id, doc_id, len(list_filter(claimed, lambda x: NOT list_contains(allowed, x))) AS ungrounded FROM p""")
def number_grounding(spark, d):
    pairs = docs_of(spark, d).join(bm25_ranking(spark, d, 10), "doc_id").join(questions_of(spark, d).withColumnRenamed("text", "question"), "query_id")
    return pairs.select("query_id", "doc_id", long(F.size(context.ungrounded_numbers(F.col("text"), F.col("question")))).alias("ungrounded"))


_RUNS = f"""{_bm25(_ANALYZE, True, 'a_')}, {_bm25(_PLAIN, False, 'b_')}, runs AS (SELECT query_id, 0 AS intent, doc_id AS item_id, rank, score FROM a_ranked WHERE rank <= 20 UNION ALL SELECT query_id, 1, doc_id, rank, score FROM b_ranked WHERE rank <= 20)"""


def intent_runs(spark, d) -> DataFrame:
    a = bm25_ranking(spark, d, 20).withColumn("intent", F.lit(0))
    b = bm25_ranking(spark, d, 20, plain_words).withColumn("intent", F.lit(1))
    return a.unionByName(b).select("query_id", "intent", F.col("doc_id").alias("item_id"), "rank", "score")


@query(f"""WITH {_RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, intent ORDER BY rank, item_id) AS depth FROM runs), f AS (SELECT query_id, item_id, min({{'d': depth, 'i': intent}}) AS first, string_agg(DISTINCT intent::VARCHAR, ',' ORDER BY intent::VARCHAR) AS intents FROM p GROUP BY ALL)
SELECT query_id, item_id, first.i::BIGINT AS intent, first.d AS depth, row_number() OVER (PARTITION BY query_id ORDER BY first.d, first.i) AS rank, intents FROM f""")
def round_robin_fuse(spark, d):
    return fusion.round_robin(intent_runs(spark, d)).withColumn("intent", long(F.col("intent")))


@query(f"""WITH {_RUNS}, e AS (SELECT query_id, item_id, intent, round(score - 15, 6) AS score FROM runs), b AS (SELECT *, max(score) OVER (PARTITION BY query_id, item_id) AS best FROM e)
SELECT query_id, item_id, intent::BIGINT AS intent, score FROM b WHERE score >= 0 OR (best < 0 AND score = best)""")
def intent_association(spark, d):
    e = intent_runs(spark, d).select("query_id", "item_id", "intent", F.round(F.col("score") - 15, 6).alias("score"))
    return fusion.associated(e).withColumn("intent", long(F.col("intent")))


@query(f"""WITH {_RUNS}, f AS (SELECT query_id, item_id, min({{'r': intent, 'k': rank, 's': score}}) AS f FROM runs GROUP BY ALL), m AS (SELECT query_id, item_id, f.r::BIGINT AS round, f.k AS rank, f.s AS score, row_number() OVER (PARTITION BY query_id ORDER BY f.s DESC, f.r, f.k, item_id) AS merged_rank FROM f) SELECT * FROM m WHERE merged_rank <= 6""")
def round_merge(spark, d):
    return fusion.merge_rounds(intent_runs(spark, d).withColumnRenamed("intent", "round"), 6).withColumn("round", long(F.col("round")))


@query(f"""WITH {_EVIDENCE}, s AS (SELECT query_id, source, round(score - 12, 6) AS score FROM evidence WHERE rank <= 6), named AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, item_id % 7 = 0 AS unavailable, item_id % 13 = 0 AS foreign_only FROM benchmark),
g AS (SELECT n.query_id, unavailable, foreign_only, count(s.score) AS n, max(s.score) AS best, coalesce(bool_or(s.source = n.source AND s.score >= 0), false) AS own FROM named n LEFT JOIN s ON s.query_id = n.query_id GROUP BY ALL),
r AS (SELECT query_id, best, CASE WHEN foreign_only THEN 'outside_only' WHEN n = 0 THEN 'nothing_retrieved' WHEN best < 0 AND unavailable THEN 'version_unavailable' WHEN best < 0 THEN 'nothing_relevant' WHEN NOT own THEN 'organization_gap' ELSE 'relevant' END AS reason FROM g)
SELECT query_id, best, reason, CASE WHEN reason IN ('outside_only', 'version_unavailable') THEN 'structural' WHEN reason = 'relevant' THEN 'sufficient' ELSE 'insufficient' END AS decision FROM r""")
def coverage_decision(spark, d):
    shown = evidence_of(spark, d).filter("rank <= 6").select("query_id", F.col("source").alias("organization"), F.round(F.col("score") - 12, 6).alias("score"))
    item, none = F.col("item_id"), F.array().cast("array<string>")
    foreign = item % 13 == 0
    asked = table(spark, d, "benchmark").select(item.alias("query_id"), F.when(foreign, none).otherwise(F.array(F.concat(F.lit("src"), (item % 20).cast("string")))).alias("organizations"), F.when(foreign, F.array(F.lit("elsewhere"))).otherwise(none).alias("outside"), (item % 7 == 0).alias("unavailable"))
    return iterate.assess(shown, asked).select("query_id", "best", "reason", "decision")


# --- conversations --------------------------------------------------------------------------------------------------

_LEAVE_OUT = sorted(set(T.KEYWORD_STOP_WORDS) | set(session.OPENER) | set(session.CANNOT_END))
_LEFT_OUT = ", ".join(f"'{w}'" for w in _LEAVE_OUT)


@query()
def turn_gate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", session.turn_kind(F.col("text")).alias("kind"))


@query(f"""WITH t AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ') AS w FROM conversations), h AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM t),
c AS (SELECT *, sum(len(list_filter(regexp_extract_all(replace(lower(word), '’', ''''), '[a-z0-9'']+'), lambda x: x NOT IN ({_LEFT_OUT}) AND NOT regexp_full_match(x, '\\d+')))) OVER (PARTITION BY conv_id, turn ORDER BY place) AS so_far FROM h)
SELECT conv_id, turn, count(*) AS n_words, min(place) FILTER (so_far >= 2) AS trigger FROM c GROUP BY ALL""")
def content_word_trigger(spark, d):
    return session.first_trigger(table(spark, d, "conversations"), ["conv_id", "turn"], _LEAVE_OUT)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_turn FROM conversations")
def context_turn(spark, d):
    return session.context_turn(table(spark, d, "conversations").withColumn("is_question", F.col("role") == "user")).select("conv_id", "turn", "context_turn")


@query("WITH i AS (SELECT conv_id AS answer_id, ntile(3) OVER (PARTITION BY conv_id ORDER BY turn) AS item, turn, text FROM conversations) SELECT answer_id, item, sha256(string_agg(text, ' ' ORDER BY turn)) AS hash FROM i GROUP BY ALL")
def present_ntile(spark, d):
    claims = table(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim"), "text")
    return session.present(claims, 3).select("answer_id", "item", T.content_hash(F.col("text")).alias("hash"))


@query()
def fragments_joined(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'user'").withColumn("kind", session.turn_kind(F.col("text")))
    return session.fragments_joined(turns).select("conv_id", "turn", "kind", T.content_hash(F.col("utterance")).alias("hash"))


_CLAIM_STOP = ", ".join(f"'{w}'" for w in sorted(CLAIM_STOP))
_WORDSET = rf"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.,]\d+)*'), lambda x: x NOT IN ({_CLAIM_STOP})))"


@query(f"WITH w AS (SELECT conv_id, turn, {_WORDSET} AS w FROM conversations) SELECT a.conv_id, a.turn, b.turn AS other, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) END AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def statement_jaccard(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    both = t.join(after, ["conv_id", "turn"])
    return both.select("conv_id", "turn", (F.col("turn") + 1).alias("other"), F.round(dialogue.statement_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


# --- events ---------------------------------------------------------------------------------------------------------

_ALLOWED = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view")]


@query("WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, before, event_type FROM l WHERE before IS NOT NULL AND before || '>' || event_type NOT IN ('view>click', 'click>purchase', 'view>view', 'click>view')")
def job_lifecycle_violations(spark, d):
    return jobs.violations(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", _ALLOWED).select("event_id", "user_id", "before", "event_type")


@query("WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM l WHERE event_type IS DISTINCT FROM before")
def event_dedup(spark, d):
    return jobs.without_repeats(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS status, count(*) AS n FROM events GROUP BY user_id")
def last_status(spark, d):
    return jobs.last_status(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


# --- catalog --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source AS organization, lang AS kind FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 50")
def named_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("organization"), F.col("lang").alias("kind"))
    return catalog.named_query(spark, "documents", {"documents": docs}, {"organization": "src3"})[0]


@query(f"WITH {_VERSIONS} SELECT doc_id, series_id, effective FROM versions WHERE series_id = 7 ORDER BY effective NULLS LAST, doc_id LIMIT 50")
def named_versions(spark, d):
    return catalog.named_query(spark, "document_versions", {"versions": versions_of(spark, d)}, {"series_id": 7})[0]


@query(f"WITH {_LINES} SELECT doc_id || '::' || seq AS chunk_id, doc_id, seq AS ordinal FROM lines WHERE doc_id = 6 ORDER BY ordinal, chunk_id LIMIT 50")
def named_chunks(spark, d):
    chunks = lines_of(spark, d).select(F.concat_ws("::", "doc_id", "seq").alias("chunk_id"), "doc_id", F.col("seq").alias("ordinal"))
    return catalog.named_query(spark, "chunks_by_document", {"chunks": chunks}, {"doc_id": 6})[0]


@query(f"WITH {_bm25(_ANALYZE, True)}, f AS (SELECT query_id, doc_id, rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 AND lang = 'en'), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS shown FROM f) SELECT query_id, doc_id, rank, shown FROM s WHERE shown <= 5")
def search_filters(spark, d):
    found = table(spark, d, "documents").select("doc_id", "lang").join(bm25_ranking(spark, d, 20), "doc_id")
    return catalog.search_filters(found, F.col("lang") == "en", 5).select("query_id", "doc_id", "rank", "shown")


@query("""WITH b AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3)
SELECT path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'missing' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN a USING (path)""")
def lock_diff(spark, d):
    docs = docs_of(spark, d).withColumnRenamed("doc_id", "path")
    before = docs.filter("path % 10 != 1").select("path", T.content_hash(F.col("text")).alias("hash"))
    after = docs.filter("path % 10 != 3").select("path", T.content_hash(F.when(F.col("path") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return catalog.snapshot_difference(before, after)


@query("""WITH m AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), c AS (SELECT o_custkey AS k, count(*) AS n, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS v FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey)
SELECT k AS doc_id, CASE WHEN c.n > 0 THEN c.v ELSE m.v END AS value, coalesce(c.n, 0) AS chunk_count FROM m FULL JOIN c USING (k)""")
def document_value_choice(spark, d):
    manifest = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("value"))
    orders = table(spark, d, "orders").filter("o_custkey % 3 != 0")
    value = F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))).over(Window.partitionBy("o_custkey"))
    return catalog.chosen_values(orders.select(F.col("o_custkey").alias("doc_id"), value.alias("value")), manifest, "doc_id", ["value"])


# --- evaluation -----------------------------------------------------------------------------------------------------

_GOLD = f"""{_bm25(_ANALYZE, True)}, b_top AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r FROM scored) WHERE r IN (1, 4, 9)),
gold AS (SELECT query_id AS case_id, doc_id AS item_id, doc_id % 2 AS unit FROM b_top), 
ur AS (SELECT case_id, unit, min(rank) AS rank FROM gold LEFT JOIN (SELECT query_id AS case_id, doc_id AS item_id, rank FROM ranked WHERE rank <= 10) USING (case_id, item_id) GROUP BY ALL),
cm AS (SELECT case_id, {', '.join(f'round(avg(coalesce(rank <= {k}, false)::INT), 6) AS recall_{k}, bool_and(coalesce(rank <= {k}, false)) AS all_{k}' for k in evaluate.CUTS)}, round(coalesce(1.0::DOUBLE / min(CASE WHEN rank <= 10 THEN rank END), 0), 6) AS mrr_10 FROM ur GROUP BY case_id)"""


def case_metrics_of(spark, d) -> DataFrame:
    asked = questions_of(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    # the best ten have the ties of either order
    both = {"r": F.row_number().over(w), "place": F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))}
    scored = held(lambda kept: lexical.best(docs_of(spark, d), asked, 10, kept=kept).withColumns(both).filter("r <= 10 OR place <= 10"), asked.count() * 20)
    gold = scored.filter(F.col("r").isin(1, 4, 9)).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("item_id"), (F.col("doc_id") % 2).alias("unit"))
    ranking = lexical.top_k(scored.select("query_id", "doc_id", "score"), 10).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("item_id"), "rank")
    return evaluate.case_metrics(evaluate.unit_ranks(gold, ranking))


@query(f"WITH {_GOLD} SELECT case_id, recall_1, recall_3, recall_5, recall_10, all_1, all_3, all_5, all_10, mrr_10 FROM cm")
def retrieval_metrics(spark, d):
    return case_metrics_of(spark, d)


@query(f"""WITH {_GOLD}, t AS (SELECT item_id AS case_id, 'len' || (length(text) % 3) AS type FROM benchmark) SELECT NULL AS type, count(*) AS n, round(avg(recall_10), 4) AS recall_10, round(avg(mrr_10), 4) AS mrr_10 FROM cm
UNION ALL SELECT type, count(*), round(avg(recall_10), 4), round(avg(mrr_10), 4) FROM cm JOIN t USING (case_id) GROUP BY type""")
def metrics_by_type(spark, d):
    types = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.concat(F.lit("len"), (F.length("text") % 3).cast("string")).alias("type"))
    return evaluate.by_type(case_metrics_of(spark, d), types, ["recall_10", "mrr_10"])


@query("SELECT o_custkey AS case_id, count(DISTINCT o_orderkey) AS n_runs, count(DISTINCT o_orderstatus) = 1 AS same FROM orders GROUP BY o_custkey")
def run_agreement(spark, d):
    return evaluate.agreement(table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("value")))


# --- numbers, warnings, sections, intents ---------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN (l_orderkey % 3000) || '.' || l_linenumber || '.0' WHEN 1 THEN 'PR' || (l_orderkey % 300) || '.' || l_linenumber WHEN 2 THEN (l_orderkey % 300) || '.' ELSE (l_orderkey % 3000) || '.51' || l_linenumber END AS number FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'decimal' WHEN 1 THEN 'prefixed' WHEN 2 THEN 'integer' END AS kind,
CASE l_linenumber % 4 WHEN 0 THEN (l_orderkey % 3000) || '/' || l_linenumber WHEN 1 THEN 'PR' || (l_orderkey % 300) || '/' || l_linenumber WHEN 2 THEN (l_orderkey % 300)::VARCHAR END AS parts FROM t""")
def clause_numbers(spark, d):
    key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("string")
    number = F.when(F.col("l_linenumber") % 4 == 0, F.concat((key % 3000).cast("string"), F.lit("."), line, F.lit(".0"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("PR"), (key % 300).cast("string"), F.lit("."), line)).when(F.col("l_linenumber") % 4 == 2, F.concat((key % 300).cast("string"), F.lit("."))).otherwise(F.concat((key % 3000).cast("string"), F.lit(".51"), line))
    parsed = table(spark, d, "lineitem").select("l_orderkey", long(F.col("l_linenumber")).alias("l_linenumber"), T.clause_number(number).alias("c"))
    return parsed.select("l_orderkey", "l_linenumber", F.col("c.kind").alias("kind"), F.array_join("c.parts", "/").alias("parts"))


@query(f"""SELECT item_id, array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(regexp_replace(w, '^["''“”‘’(\\[]+', ''), '["''“”‘’)\\],.;:?!]+$', '')), lambda w: w <> '' AND lower(w) NOT IN ({', '.join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS)})), ' ') AS keywords FROM benchmark""")
def keyword_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.keyword_query(F.col("text")).alias("keywords"))


@query(f"""WITH {_BLOCKS}, k AS (SELECT doc_id, seq, text, CASE WHEN kind = 'heading' AND seq % 3 = 0 THEN 'list_item' ELSE kind END AS kind FROM blocks), p AS (SELECT *, kind = 'list_item' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) IS DISTINCT FROM 'list_item' AS begins FROM k)
SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY seq)) AS content_hash, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_heading, count(*) FILTER (kind = 'list_item') AS n_list_item, count(*) FILTER (begins) AS n_lists, sum(length(text))::BIGINT AS chars FROM p GROUP BY doc_id""")
def document_hashes(spark, d):
    b = blocks_of(spark, d).withColumn("kind", F.when((F.col("kind") == "heading") & (F.col("seq") % 3 == 0), "list_item").otherwise(F.col("kind")))
    return pages.document_hashes(b).select("doc_id", "content_hash", "n_blocks", "n_heading", "n_list_item", "n_lists", "chars")


@query("SELECT doc_id, doc_id AS page, CASE WHEN trim(text, ' ') = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'no_text_layer' ELSE 'blank_page' END WHEN trim(substr(text, 1, 60), ' ') = '' THEN 'empty_after_cleaning' ELSE 'near_empty_page' END AS code FROM documents WHERE trim(text, ' ') = '' OR length(substr(text, 1, 60)) < 40 OR trim(substr(text, 1, 60), ' ') = ''")
def page_warnings(spark, d):
    p = docs_of(spark, d).select("doc_id", F.col("doc_id").alias("page"), F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("image_count"), F.substring("text", 1, 60).alias("kept"))
    return pages.document_warnings(p)


@query("SELECT source AS value, count(*) AS documents FROM documents GROUP BY source")
def corpus_info(spark, d):
    return catalog.corpus_info(table(spark, d, "documents"), "source")


@query("""WITH s AS (SELECT o_custkey AS series_id, o_orderkey AS doc_id, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS hashes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT series_id, count(*) AS n_versions, count(DISTINCT hashes) > 1 AS differ FROM s GROUP BY series_id""")
def version_eligibility(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("h"))
    sources = table(spark, d, "orders").join(lines, "o_orderkey").select(F.lit(0).alias("query_id"), F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("doc_id"), F.col("h").alias("content_hash"))
    return context.differing_series(sources).select("series_id", "n_versions", "differ")


@query("""WITH o AS (SELECT o_custkey AS query_id, o_orderkey AS intent, CASE WHEN o_orderkey % 3 = 0 THEN 'org' || (o_orderkey % 2) ELSE NULL END AS org FROM orders),
n AS (SELECT query_id, count(DISTINCT org) AS n, min(org) AS sole FROM o GROUP BY query_id) SELECT query_id, intent, CASE WHEN org IS NULL AND n = 1 THEN sole ELSE '' END AS carried, org IS NULL AND n > 1 AS ambiguous FROM o JOIN n USING (query_id)""")
def organization_carry(spark, d):
    o = table(spark, d, "orders")
    named = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("org"), (F.col("o_orderkey") % 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    i = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("intent"), named.alias("organizations"))
    return multi.carry(i).select("query_id", "intent", F.array_join("carried", ",").alias("carried"), "ambiguous")


@query("""WITH f AS (SELECT o_custkey AS query_id, o_orderkey AS intent, o_totalprice > 50000 AS admissible, o_orderstatus = 'F' AS covered, o_orderkey % 11 = 0 AS blocked, o_orderpriority <> '1-URGENT' AS same FROM orders),
g AS (SELECT query_id, count(*) AS n, count(*) FILTER (admissible) AS ok, count(*) FILTER (admissible AND NOT covered) AS uncovered, count(*) FILTER (blocked) AS blocked, count(*) FILTER (admissible AND NOT same) AS other FROM f GROUP BY query_id)
SELECT query_id, CASE WHEN n = 1 OR (uncovered = 0 AND blocked = 0) THEN 'delegate' WHEN ok = 0 THEN 'no_supported_intent' WHEN other = 0 THEN 'fused' ELSE 'per_intent' END AS strategy FROM g""")
def intent_strategy(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("intent"), (F.col("o_totalprice") > 50000).alias("admissible"), (F.col("o_orderstatus") == "F").alias("covered"), (F.col("o_orderkey") % 11 == 0).alias("blocked"), (F.col("o_orderpriority") != "1-URGENT").alias("same"))
    return multi.strategy(f)


@query()
def temporal_intents(spark, d):
    i = table(spark, d, "conversations").select("conv_id", "turn", dates.temporal_intent("text").alias("i"))
    return i.select("conv_id", "turn", F.col("i.kind").alias("kind"), long(F.size("i.dates")).alias("n_dates"))


@query()
def decomposed_questions(spark, d):
    return multi.decompose(table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text"))


@query(f"""WITH t AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ') AS w, role FROM conversations), h AS (SELECT conv_id, turn, role, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM t),
c AS (SELECT *, sum(len(list_filter(regexp_extract_all(replace(lower(word), '’', ''''), '[a-z0-9'']+'), lambda x: x NOT IN ({_LEFT_OUT}) AND NOT regexp_full_match(x, '\\d+')))) OVER (PARTITION BY conv_id, turn ORDER BY place) AS so_far FROM h),
e AS (SELECT conv_id, turn, role, count(*) AS n, min(place) FILTER (so_far >= 2) AS trigger FROM c GROUP BY ALL)
SELECT role, count(*) AS n, round(avg((trigger < n)::INT), 6) AS early, round(avg(400 * (n - trigger)), 6) AS mean_lead_ms FROM e GROUP BY role""")
def early_retrieval(spark, d):
    e = session.first_trigger(table(spark, d, "conversations"), ["conv_id", "turn", "role"], _LEAVE_OUT)
    early = F.avg((F.col("trigger") < F.col("n_words")).cast("int"))
    return e.groupBy("role").agg(F.count("*").alias("n"), F.round(early, 6).alias("early"), F.round(F.avg(400 * (F.col("n_words") - F.col("trigger"))), 6).alias("mean_lead_ms"))
