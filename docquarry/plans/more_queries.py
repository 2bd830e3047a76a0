"""More of the engine's operators on the driver's tables, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.intents import Directory
from docquarry.operators import catalog, chunking, clauses, context, dialogue, evaluate, iterate, jobs, multi, pages, session, temporal, verify
from docquarry.plans.queries import _EVIDENCE, _LINES, _VERSIONS, blocks_of, evidence_of, lines_of, long, price_ranking, query, table, versions_of
from docquarry.sources import files


def directory() -> Directory:
    """Organizations that the conversations' questions may name."""
    return Directory(["University of Connecticut", "Rutgers University"], {"UConn": "University of Connecticut", "Rutgers": "Rutgers University"})


def unit_blocks(spark, d) -> DataFrame:
    """Lines as blocks: every fifth is a numbered clause, every seventh that looks like one a heading."""
    number = F.when(F.col("seq") % 5 == 0, F.concat((F.floor(F.col("seq") / 25) + 1).cast("string"), F.lit("."), (F.col("seq") % 25 + 1).cast("string")))
    b = blocks_of(spark, d).withColumn("kind", F.when((F.col("kind") == "heading") & (F.col("seq") % 7 == 0), "heading").when(F.col("seq") % 5 == 0, "list_item").otherwise("paragraph"))
    return b.select(F.col("doc_id").cast("string").alias("doc_id"), "seq", "kind", "text", F.when(F.col("kind") == "list_item", number).alias("number"), F.when(F.col("kind") == "heading", F.lit(1)).alias("level"), F.lit("Corpus").alias("title"), F.col("source").alias("organization"))


# --- chunks ---------------------------------------------------------------------------------------------------------


@query()
def document_chunks(spark, d):
    c = clauses.chunk_documents(unit_blocks(spark, d))
    return c.select("doc_id", "chunk_id", "ordinal", "clause_id", F.array_join("section_path", " > ").alias("path"), "tokens", "retrieval_tokens", "content_hash", "split", "confidence", "retrievable")


@query()
def document_diagnostics(spark, d):
    return clauses.chunk_diagnostics(unit_blocks(spark, d))


@query()
def document_outlines(spark, d):
    return clauses.outline_rows(unit_blocks(spark, d)).select("doc_id", "seq", F.array_join("path", " > ").alias("path"), "clause")


_GRID = f"""{_LINES}, f AS (SELECT doc_id, seq, (seq * 37) % 5 * 30 AS x, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ')) END <= 10 AS frag FROM lines),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, frag ORDER BY seq) AS run, x - lag(x) OVER (PARTITION BY doc_id ORDER BY seq) AS step, lag(frag) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM f),
r AS (SELECT doc_id, run, min(seq) AS a, max(seq) AS b FROM i WHERE frag GROUP BY ALL HAVING count(*) >= 6 AND count(*) FILTER (before AND abs(step) > 40) >= 3),
n AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM r)"""


@query(f"WITH {_GRID} SELECT DISTINCT f.doc_id, f.seq FROM f JOIN n ON n.doc_id = f.doc_id AND (f.seq BETWEEN a AND b OR (next - b - 1 <= 2 AND f.seq > b AND f.seq < next))")
def grid_regions(spark, d):
    return clauses.grid_blocks(lines_of(spark, d).select("doc_id", "seq", "text", ((F.col("seq") * 37) % 5 * 30).cast("double").alias("x")))


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN l_partkey % 3 = 0 THEN [(l_partkey % 4 + 1)::VARCHAR, (l_suppkey % 5 + 1)::VARCHAR] WHEN l_partkey % 3 = 1 THEN [(l_partkey % 4 + 1)::VARCHAR] ELSE [(l_partkey % 4 + 1)::VARCHAR, (l_suppkey % 5 + 1)::VARCHAR, (l_partkey % 7 + 1)::VARCHAR] END AS parts FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem)),
k AS (SELECT DISTINCT doc_id, parts FROM b)
SELECT doc_id, seq FROM b WHERE len(parts) > 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = b.doc_id AND (k.parts = b.parts[1:len(b.parts) - 1] OR (k.parts <> b.parts AND ((len(k.parts) = len(b.parts) AND k.parts[1:len(k.parts) - 1] = b.parts[1:len(b.parts) - 1]) OR (len(k.parts) > len(b.parts) AND k.parts[1:len(b.parts)] = b.parts)))))""")
def foreign_numbers(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    a, b, c = ((part % 4 + 1).cast("string"), (supp % 5 + 1).cast("string"), (part % 7 + 1).cast("string"))
    number = F.when(part % 3 == 0, F.concat_ws(".", a, b)).when(part % 3 == 1, a).otherwise(F.concat_ws(".", a, b, c))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), long(F.row_number().over(w)).alias("seq"), F.lit("list_item").alias("kind"), number.alias("number"))
    return clauses.foreign_number_blocks(rows)


@query(f"WITH {_LINES}, b AS (SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN 'heading' ELSE 'list_item' END AS kind, chr(97 + CAST((seq + length(text) % 2) % 26 AS INTEGER)) AS m FROM lines), p AS (SELECT *, lag(kind) OVER w AS k, lag(m) OVER w AS before FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq FROM p WHERE kind = 'heading' AND k = 'list_item' AND ascii(m) = ascii(before) + 1")
def list_continuations(spark, d):
    letter = F.char(97 + (F.col("seq") + F.length("text") % 2) % 26)
    b = lines_of(spark, d).select("doc_id", "seq", F.when(F.col("seq") % 2 == 0, "heading").otherwise("list_item").alias("kind"), F.concat(letter, F.lit(".")).alias("marker"), F.lit(0.0).alias("x"))
    return clauses.list_continuations(b).select("doc_id", "seq")


@query("SELECT o_orderkey, nullif(regexp_extract(t, '\\b(?:Standard|Section|Chapter|Article|Part)\\s+(\\d{1,3})\\b', 1), '') AS number FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Standard ' || (o_custkey % 2000) || ': x' WHEN 1 THEN 'See Part ' || (o_custkey % 90) ELSE 'None' END AS t FROM orders)")
def implied_numbers(spark, d):
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.when(key % 3 == 0, F.concat(F.lit("Standard "), (c % 2000).cast("string"), F.lit(": x"))).when(key % 3 == 1, F.concat(F.lit("See Part "), (c % 90).cast("string"))).otherwise("None")
    return table(spark, d, "orders").select("o_orderkey", clauses.implied_number(t).alias("number"))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, seq, text, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ')) END <= 10 AND NOT ends_with(text, '.') AS short FROM lines),
r AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, short ORDER BY seq) AS run FROM s), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, short, run) AS n FROM r) SELECT doc_id, seq, short AND n >= 3 AS listed FROM n""")
def implicit_lists(spark, d):
    b = lines_of(spark, d).withColumns({"kind": F.lit("paragraph"), "line_count": F.lit(1), "x": F.lit(50.0)})
    return pages.implicit_list_runs(b).select("doc_id", "seq", "listed")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, l_returnflag AS title FROM lineitem), t AS (SELECT doc_id, k, title, CASE WHEN k > 1 AND k <= 6 THEN k // 2 END AS parent FROM s),
w(doc_id, k, path) AS (SELECT doc_id, k, title FROM t WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.k, w.path || ' > ' || t.title FROM t JOIN w ON w.doc_id = t.doc_id AND w.k = t.parent) SELECT doc_id, k AS section_id, path FROM w""")
def section_paths(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    k = long(F.row_number().over(w))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), k.alias("section_id"), F.col("l_returnflag").alias("title"))
    s = s.withColumn("parent_id", F.when((F.col("section_id") > 1) & (F.col("section_id") <= 6), F.floor(F.col("section_id") / 2)))
    return pages.section_paths(s).select("doc_id", "section_id", F.array_join("path", " > ").alias("path"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'web_print' WHEN 1 THEN 'office_export' WHEN 2 THEN 'office_export' WHEN 3 THEN 'generic' ELSE 'kept' END AS profile FROM customer")
def profiles(spark, d):
    k = F.col("c_custkey") % 5
    producer = F.when(k == 0, "Skia/PDF m120").when(k == 1, "Microsoft Word 2019").otherwise("x")
    creator = F.when(k == 0, "Mozilla/5.0").when(k == 2, "Acrobat PDFMaker 17")
    return table(spark, d, "customer").select("c_custkey", pages.profile(producer, creator, F.when(k == 4, "kept")).alias("profile"))


@query("SELECT o_orderkey, 'd' || o_custkey || '::' || lpad((o_orderkey % 90)::VARCHAR, 3, '0') || '-' || substr(sha256('d' || o_custkey || '|b1,b' || o_orderkey || '|' || CASE WHEN o_orderkey % 2 = 0 THEN '(3, ' || o_orderkey || ')' ELSE 'None' END || '|' || CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END), 1, 12) AS chunk_id FROM orders")
def chunk_ids(spark, d):
    key = F.col("o_orderkey")
    doc = F.concat(F.lit("d"), F.col("o_custkey").cast("string"))
    span = F.when(key % 2 == 0, F.array(F.lit(3).cast("long"), key.cast("long")))
    return table(spark, d, "orders").select("o_orderkey", chunking.chunk_id(doc, (key % 90).cast("int"), F.array(F.lit("b1"), F.concat(F.lit("b"), key.cast("string"))), span, key % 3 == 0).alias("chunk_id"))


@query(f"WITH {_LINES}, c AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN ['table_low_confidence'] WHEN seq % 3 = 1 THEN ['low_confidence_heading'] ELSE [] END AS reasons, text FROM lines) SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, sha256('T' || CASE WHEN seq % 2 = 0 THEN ' (O)' ELSE '' END || CASE WHEN seq % 4 = 0 THEN '' ELSE chr(10) || 'A > B' END || CASE WHEN seq % 5 = 0 THEN chr(10) || 'lead' ELSE '' END || chr(10) || text) AS hash FROM c")
def retrieval_texts(spark, d):
    seq = F.col("seq")
    reasons = F.when(seq % 3 == 0, F.array(F.lit("table_low_confidence"))).when(seq % 3 == 1, F.array(F.lit("low_confidence_heading"))).otherwise(F.array().cast("array<string>"))
    path = F.when(seq % 4 == 0, F.array(F.lit("t"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    text = chunking.retrieval_text(F.lit("T"), F.when(seq % 2 == 0, "O"), path, F.when(seq % 5 == 0, "lead"), F.col("text"))
    return lines_of(spark, d).select("doc_id", "seq", chunking.confidence(reasons).alias("confidence"), F.sha2(text, 256).alias("hash"))


@query("SELECT l_orderkey, max(l_linenumber)::BIGINT AS rows, string_agg(l_returnflag || ': ' || l_quantity::BIGINT, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS text FROM lineitem GROUP BY l_orderkey")
def key_value_tables(spark, d):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.array("l_returnflag", long(F.col("l_quantity")).cast("string")).alias("cells"))
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(long(F.max("l_linenumber")).alias("rows"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["cells"]).alias("cells"))
    return t.select("l_orderkey", "rows", chunking.key_value_table(F.col("cells")).alias("text"))


# --- versions, answers and intents ----------------------------------------------------------------------------------

_INTENTS = "intents AS (SELECT q AS query_id, CASE q % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'current' WHEN 2 THEN 'day' ELSE 'month' END AS kind FROM range(50) r(q))"
_SELECTED = f"""{_VERSIONS}, {_INTENTS}, ranking AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS item_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
reg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM versions) WHERE n >= 2), asked AS (SELECT DISTINCT query_id, series_id FROM ranking JOIN reg USING (doc_id)),
named AS (SELECT DISTINCT series_id FROM reg WHERE year(effective) = 1997 AND month(effective) = 3),
sel AS (SELECT query_id, a.series_id, kind, list_sort(list(doc_id) FILTER (CASE kind WHEN 'current' THEN is_current WHEN 'day' THEN effective <= DATE '1998-01-01' AND (superseded IS NULL OR DATE '1998-01-01' < superseded)
  WHEN 'month' THEN CASE WHEN a.series_id IN (SELECT series_id FROM named) THEN year(effective) = 1997 AND month(effective) = 3 ELSE effective <= DATE '1997-03-01' AND (superseded IS NULL OR DATE '1997-03-01' < superseded) END END)) AS docs
  FROM asked a JOIN intents USING (query_id) JOIN reg ON reg.series_id = a.series_id WHERE kind <> 'neutral' GROUP BY ALL)"""


def selection(spark, d):
    day = "array<struct<year: int, month: int, day: int>>"
    date = lambda m, x: F.array(F.struct(F.lit(1998 if x else 1997).alias("year"), F.lit(m).alias("month"), F.lit(x).cast("int").alias("day")))
    q = F.col("query_id")
    intents = spark.range(50).select(F.col("id").alias("query_id")).select("query_id", F.when(q % 4 == 0, "neutral").when(q % 4 == 1, "current").otherwise("point_in_time").alias("kind"), F.when(q % 4 == 2, date(1, 1)).when(q % 4 == 3, date(3, None)).otherwise(F.array().cast(day)).alias("dates"))
    registry = temporal.registry(versions_of(spark, d))
    ranking = price_ranking(spark, d)
    return registry, ranking, temporal.select(registry, intents, temporal.series_in(ranking, registry))


@query(f"WITH {_SELECTED} SELECT query_id, series_id, coalesce(array_to_string(docs, ','), '') AS doc_ids FROM sel WHERE NOT (kind = 'current' AND coalesce(len(docs), 0) <> 1)")
def version_selection(spark, d):
    _, _, (selected, _) = selection(spark, d)
    return selected.select("query_id", "series_id", F.array_join(F.array_sort("doc_ids"), ",").alias("doc_ids"))


@query(f"WITH {_SELECTED} SELECT query_id, CASE WHEN kind = 'current' THEN 'current_version_ambiguous:' ELSE 'requested_version_unavailable:' END || series_id AS flag FROM sel WHERE (kind = 'current' AND coalesce(len(docs), 0) <> 1) OR (kind <> 'current' AND coalesce(len(docs), 0) = 0)")
def version_flags(spark, d):
    return selection(spark, d)[2][1]


@query(f"""WITH {_SELECTED}, k AS (SELECT r.query_id, r.item_id, r.rank FROM ranking r LEFT JOIN reg USING (doc_id) LEFT JOIN sel ON sel.query_id = r.query_id AND sel.series_id = reg.series_id AND NOT (sel.kind = 'current' AND coalesce(len(sel.docs), 0) <> 1)
  WHERE sel.series_id IS NULL OR list_contains(coalesce(sel.docs, []), r.doc_id))
SELECT query_id, item_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept_rank FROM k""")
def temporal_resolve(spark, d):
    registry, ranking, (selected, _) = selection(spark, d)
    return temporal.resolve(ranking, registry, selected).select("query_id", "item_id", "rank", "kept_rank")


@query(f"WITH {_VERSIONS}, {_INTENTS}, e AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS item_id, o_custkey AS series_id, o_orderkey AS doc_id FROM orders), v AS (SELECT o_custkey % 50 AS query_id, o_custkey AS split_series, o_orderkey AS split_doc FROM orders WHERE o_custkey < 50) SELECT e.query_id, e.item_id, v.split_doc FROM e JOIN v USING (query_id) WHERE e.series_id <> v.split_series OR e.doc_id = v.split_doc")
def version_slices(spark, d):
    o = table(spark, d, "orders")
    e = o.select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("doc_id"))
    v = o.filter("o_custkey < 50").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_custkey").alias("split_series"), F.col("o_orderkey").alias("split_doc"))
    return multi.version_slices(e, v).select("query_id", "item_id", "split_doc")


_PARTS = """claims AS (SELECT l_orderkey AS query_id, l_linenumber % 3 AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS claim, l_returnflag AS text, [l_suppkey % 5, l_partkey % 5 + 5] AS items FROM lineitem),
parts AS (SELECT DISTINCT query_id, part FROM claims UNION SELECT DISTINCT query_id, 3 FROM claims), u AS (SELECT query_id, part, claim, unnest(items) AS item_id, generate_subscripts(items, 1) AS place FROM claims),
f AS (SELECT query_id, item_id, min({'a': part, 'b': claim, 'c': place}) AS first FROM u GROUP BY ALL), n AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS number FROM f)"""


def split_answers(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 3).alias("part"), F.row_number().over(w).alias("claim"), F.col("l_returnflag").alias("text"), F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5 + 5).alias("items"))
    answered = claims.select("query_id", "part").distinct().withColumn("status", F.lit("answered"))
    parts = answered.unionByName(claims.select("query_id", F.lit(3).cast(claims.schema["part"].dataType).alias("part")).distinct().withColumn("status", F.lit("abstained")))
    parts = parts.select("query_id", "part", F.concat(F.lit("Part "), F.col("part").cast("string")).alias("label"), "status", F.lit("no_evidence").alias("reason"), F.when(F.col("part") == 1, F.array(F.lit("the fee."))).otherwise(F.array().cast("array<string>")).alias("gaps"))
    return multi.combined(parts, claims)


@query(f"""WITH {_PARTS}, m AS (SELECT query_id, part, claim, string_agg('[' || number || ']', '' ORDER BY place) AS marks FROM u JOIN n USING (query_id, item_id) GROUP BY ALL),
s AS (SELECT query_id, part, string_agg(text || '.' || marks, ' ' ORDER BY claim) AS said FROM claims JOIN m USING (query_id, part, claim) GROUP BY ALL)
SELECT query_id, 'answered' AS status, string_agg('Part ' || part || ': ' || CASE WHEN part = 3 THEN 'the retrieved sources do not answer this part.' ELSE said || CASE WHEN part = 1 THEN ' Not in the sources: the fee.' ELSE '' END END, chr(10) ORDER BY part) AS text FROM parts LEFT JOIN s USING (query_id, part) GROUP BY query_id""")
def combined_answers(spark, d):
    return split_answers(spark, d)[0]


@query(f"WITH {_PARTS} SELECT query_id, 'Part 1: the fee.' AS gap FROM parts WHERE part = 1 UNION ALL SELECT query_id, 'Part 3: no verified answer (no_evidence)' FROM parts WHERE part = 3")
def combined_gaps(spark, d):
    return split_answers(spark, d)[2]


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey % 4 AS item_id, o_orderkey % 3 AS intent FROM orders), c AS (SELECT o_custkey AS query_id, o_orderkey AS claim, o_orderkey % 4 AS item_id FROM orders)
SELECT query_id, claim, array_to_string(list_sort(list_distinct(list(intent))), ',') AS intents FROM c JOIN (SELECT DISTINCT * FROM r) USING (query_id, item_id) GROUP BY query_id, claim""")
def claim_intents(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 4).alias("item_id"), (F.col("o_orderkey") % 3).alias("intent")).distinct()
    c = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("claim"), (F.col("o_orderkey") % 4).alias("item_id"))
    return multi.claim_intents(c, a).select("query_id", "claim", F.array_join(F.transform("intents", lambda x: x.cast("string")), ",").alias("intents"))


@query(f"WITH {_EVIDENCE}, c AS (SELECT query_id, item_id, hash FROM evidence WHERE rank <= 3), t AS (SELECT query_id, item_id, hash, rank FROM evidence WHERE rank IN (2, 5)) SELECT query_id, item_id, EXISTS (SELECT 1 FROM c WHERE c.query_id = t.query_id AND (c.item_id = t.item_id OR c.hash = t.hash)) AS covered FROM t")
def covered_intents(spark, d):
    e = evidence_of(spark, d).select("query_id", "item_id", "content_hash", "rank")
    return multi.covered(e.filter("rank IN (2, 5)"), e.filter("rank <= 3").select("query_id", "item_id", "content_hash")).select("query_id", "item_id", "covered")


@query()
def judged_answers(spark, d):
    e = evidence_of(spark, d).filter("rank <= 3")
    sources = e.select(F.col("query_id").alias("answer_id"), F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"), "text", F.lit("").alias("meta"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("series_id"), F.lit(None).cast("string").alias("effective"), F.lit(None).cast("string").alias("superseded"))
    first = F.substring("text", 1, 60)
    claim = F.struct(first.alias("text"), F.array("label").alias("sources"), F.array(first).alias("quotes"))
    body = F.to_json(F.struct(F.lit("answered").alias("status"), F.collect_list(claim).alias("claims"), F.array().cast("array<string>").alias("not_in_sources")))
    answers = sources.groupBy("answer_id").agg(body.alias("body"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("question"), F.lit(None).cast("map<string, array<string>>").alias("asked"))
    return verify.judged(answers, sources, questions).select("answer_id", "status", "accepted", long(F.size("problems")).alias("n_problems"))


@query(f"WITH {_EVIDENCE} SELECT query_id, string_agg('[S' || rank || '] | document: ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' | organization: ' || source ELSE '' END || chr(10) || hash, chr(10) || chr(10) ORDER BY rank) AS text FROM evidence WHERE rank <= 6 GROUP BY query_id")
def rendered_contexts(spark, d):
    e = evidence_of(spark, d).filter("rank <= 6").withColumn("label", F.concat(F.lit("S"), F.col("rank").cast("string")))
    header = context.source_header(F.col("label"), {"document": F.col("doc_id"), "organization": F.when(F.col("doc_id") % 2 == 0, F.col("source"))})
    return context.rendered(e.select("query_id", "rank", "label", header.alias("header"), F.col("content_hash").alias("text"), F.lit(None).cast("string").alias("duplicate_of")))


# --- iteration ------------------------------------------------------------------------------------------------------


@query()
def promoted_evidence(spark, d):
    e = evidence_of(spark, d).select("query_id", "item_id", F.col("source").alias("organization"), (F.col("score") - 8).alias("score"), "rank")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("organizations"))
    return iterate.promote(e, asked, 10)


# --- conversations --------------------------------------------------------------------------------------------------


@query()
def read_turns(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'").select(long(F.col("conv_id")).alias("conv_id"), long(F.col("turn")).alias("turn"), "text", session.turn_kind(F.col("text")).alias("kind"))
    return dialogue.read_turns(t, directory()).select("conv_id", "turn", "kind", "query", "anchor", "delta")


@query("SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(trim(text, ' '), '\\?+$', ''), ' '), '(?i)^(?:(?:what|which)\\s+(?:is|are|was|were)|what\\s+about|how\\s+about)\\s+(?:the\\s+)?', ''), ' ') AS phrase FROM conversations")
def topic_phrases(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", dialogue.topic_phrase(F.col("text")).alias("phrase"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'refinement' ELSE 'follow_up' END AS kind FROM conversations), w(conv_id, turn, first_turn, version) AS (SELECT conv_id, turn, turn, 1 FROM t WHERE kind <> 'refinement' OR turn = 0
  UNION ALL SELECT t.conv_id, t.turn, w.first_turn, w.version + 1 FROM t JOIN w ON w.conv_id = t.conv_id AND w.turn = t.turn - 1 WHERE t.kind = 'refinement') SELECT conv_id, turn, first_turn, version::BIGINT AS version FROM w""")
def answer_versions(spark, d):
    t = table(spark, d, "conversations").select(long(F.col("conv_id")).alias("conv_id"), long(F.col("turn")).alias("turn"), F.when(F.col("turn") % 3 == 2, "refinement").otherwise("follow_up").alias("kind"), long(F.col("turn") - 1).alias("anchor"))
    return dialogue.answer_versions(t).withColumn("version", long(F.col("version")))


# --- jobs and catalog -----------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'q' || o_orderkey END AS question, o_orderkey % 4 = 0 AS done FROM orders)
SELECT job::VARCHAR AS job_id, 0 AS seq, 'processing' AS status FROM r WHERE NOT done AND question <> '' UNION ALL SELECT job::VARCHAR, 1, CASE WHEN done THEN 'completed' WHEN question = '' OR job % 7 = 0 THEN 'failed' ELSE 'completed' END FROM r""")
def worker_events(spark, d):
    key = F.col("o_orderkey")
    o = table(spark, d, "orders")
    requests = o.select(key.cast("string").alias("job_id"), F.lit("s").alias("session_id"), F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("q"), key.cast("string"))).alias("question"))
    finished = o.filter("o_orderkey % 4 = 0").select(key.cast("string").alias("job_id"), F.lit("completed").alias("status"), F.lit("r").alias("result"), F.lit(None).cast("string").alias("error"))

    def answer(asked: DataFrame) -> DataFrame:
        return asked.select("job_id", F.lit("r").alias("result"), F.when(F.col("job_id").cast("long") % 7 == 0, "broken").alias("error"))

    events, _, _ = jobs.work(requests, finished, answer)
    return events.select("job_id", long(F.col("seq")).alias("seq"), "status")


@query(f"""WITH {_EVIDENCE.replace('rank <= 10', 'rank <= 20')}, a AS (SELECT query_id, item_id, rank, CASE item_id % 4 WHEN 0 THEN 'not_in_force' WHEN 1 THEN 'in_force' WHEN 2 THEN 'undetermined' ELSE 'not_in_force' END AS applies, item_id % 5 = 0 AS stale FROM evidence),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS shown FROM a WHERE applies <> 'not_in_force' AND NOT stale) SELECT query_id, item_id, rank, applies, shown FROM k WHERE shown <= 5""")
def document_search(spark, d):
    from docquarry.plans.queries import bm25_ranking

    item = F.col("doc_id") % 4
    pool = bm25_ranking(spark, d, 20).select("query_id", "rank", F.col("doc_id").alias("item_id"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 5 != 0).alias("is_current"), F.when(item == 0, "2030-01-01").when(item == 1, "2001-01-01").when(item == 2, "2001-01").otherwise("2001-01-01").alias("effective_date"), F.when(item == 3, "2002-02-02").alias("superseded_date"))
    return catalog.document_search(pool, current_only=True, as_of="2010-01-01", limit=5)[0].select("query_id", "item_id", "rank", "applies", "shown")


@query("SELECT c_custkey AS doc_id, c_mktsegment AS organization FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 1")
def metadata_lookup(spark, d):
    k = F.col("c_custkey") % 3
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("organization"), F.when(k == 0, True).when(k == 1, False).alias("is_current"))
    return catalog.metadata_lookup(docs, current_only=True, organization="BUILDING").select("doc_id", "organization")


@query("WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS page FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM p WHERE page <> 2) SELECT doc_id, page FROM n WHERE k IN (1, n // 2 + 1, n)")
def page_samples(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), long(F.row_number().over(w)).alias("page"))
    return catalog.page_sample(p.withColumn("text", F.when(F.col("page") != 2, "x").otherwise(" "))).select("doc_id", "page")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'status=' || substr(repeat(event_type, 100), 1, 256) ELSE 'status=' || substr(repeat(event_type, 100), 1, 256) || ',user=' || user_id END AS kept FROM events")
def span_attributes(spark, d):
    odd = F.col("event_id") % 2 == 1
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("status"), F.repeat("event_type", F.lit(100)), F.lit("user"), F.when(odd, F.col("user_id").cast("string")), F.lit("secret"), F.lit("x")).alias("attributes"))
    kept = catalog.safe_attributes(e, ["status", "user"])
    return kept.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("kept"))


@query("""WITH o AS (SELECT c_custkey AS doc, CASE c_custkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'domain' WHEN 2 THEN 'is_current' ELSE 'other' END AS field, c_mktsegment AS value, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'nowhere to be found' END AS evidence, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'seen' END AS basis FROM customer)
SELECT doc AS doc_id, field, CASE WHEN field = 'other' THEN 'unknown field' WHEN field = 'title' THEN 'evidence not in document' WHEN basis = '' THEN 'no basis given' WHEN evidence LIKE 'nowhere%' THEN 'evidence not in document' ELSE 'must be true or false' END AS reason FROM o
WHERE field = 'other' OR (field = 'title' AND evidence LIKE 'nowhere%') OR (field IN ('domain', 'is_current') AND (basis = '' OR evidence LIKE 'nowhere%' OR field = 'is_current'))""")
def refused_overrides(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    field = F.when(k % 4 == 0, "title").when(k % 4 == 1, "domain").when(k % 4 == 2, "is_current").otherwise("other")
    o = c.select(k.alias("doc_id"), field.alias("field"), F.col("c_mktsegment").alias("value"), F.when(k % 3 == 0, F.upper("c_name")).otherwise("nowhere to be found").alias("evidence"), F.when(k % 5 == 0, "").otherwise("seen").alias("basis"))
    return files.checked_overrides(o, c.select(k.alias("doc_id"), F.concat(F.lit("By "), "c_name", F.lit("  of it")).alias("text")))[1]


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN 12 ELSE 13 END AS n_missing, CASE WHEN c_custkey % 3 = 0 THEN 'near_empty' ELSE '' END AS info FROM customer""")
def manifest_rows(spark, d):
    k = F.col("c_custkey").alias("doc_id")
    c = table(spark, d, "customer")
    fields = c.filter("c_custkey % 2 = 0").select(k, F.lit("title").alias("field"), F.col("c_name").alias("value"), F.lit("label").alias("source")).unionByName(c.select(k, F.lit("domain").alias("field"), F.col("c_mktsegment").alias("value"), F.lit("curated").alias("source")))
    warned = c.filter("c_custkey % 3 = 0").select(k, F.lit("near_empty").alias("code"), F.lit("info").alias("severity"))
    return files.manifest_rows(c.select(k), fields, warned).select("doc_id", "title", long(F.size("missing_metadata")).alias("n_missing"), F.array_join("info", ",").alias("info"))


# --- evaluation -----------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey AS case_id, CASE l_linenumber % 4 WHEN 0 THEN 'citation' WHEN 1 THEN 'context' WHEN 2 THEN 'retrieval' ELSE 'generation' END AS stage, CASE l_linenumber % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS k FROM lineitem)
SELECT case_id, arg_min(stage, k) AS primary_stage, array_to_string(list_sort(list_distinct(list(stage))), ',') AS stages, count(*) AS n FROM f GROUP BY case_id""")
def failure_stages(spark, d):
    k = F.col("l_linenumber") % 4
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(k == 0, "citation").when(k == 1, "context").when(k == 2, "retrieval").otherwise("generation").alias("stage"))
    return evaluate.first_failures(f).select("case_id", "primary_stage", F.array_join("stages", ",").alias("stages"), "n")


@query("""WITH c AS (SELECT l_orderkey AS case_id, l_partkey AS item_id, CASE WHEN min(l_linenumber) % 2 = 0 THEN 'gold' ELSE 'wrong' END AS kind, CASE WHEN min(l_suppkey) % 5 = 0 THEN NULL ELSE min(l_linenumber) * 2 END AS b, min(l_linenumber) AS a FROM lineitem GROUP BY ALL)
SELECT case_id, CASE WHEN count(*) FILTER (kind = 'gold' AND (b IS NULL OR b > 10)) = 0 THEN max(b) FILTER (kind = 'gold') END::BIGINT AS gold_before, CASE WHEN count(*) FILTER (kind = 'gold' AND a > 10) = 0 THEN max(a) FILTER (kind = 'gold') END::BIGINT AS gold_after, count(*) FILTER (kind = 'wrong' AND b <= 10) AS wrong_before, count(*) FILTER (kind = 'wrong' AND a <= 10) AS wrong_after FROM c GROUP BY case_id""")
def temporal_effect(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("item_id")).agg(F.min("l_linenumber").alias("n"), F.min("l_suppkey").alias("s"))
    cases = c.select("case_id", "item_id", F.when(F.col("n") % 2 == 0, "gold").otherwise("wrong").alias("kind"))
    ranks = c.select("case_id", "item_id", F.when(F.col("s") % 5 != 0, long(F.col("n") * 2)).alias("before"), long(F.col("n")).alias("after"))
    return evaluate.temporal_effect(cases, ranks)


@query("""WITH c AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, o_orderstatus || (o_orderkey % 3) AS path FROM orders) SELECT a.chunk_id, min(b.chunk_id) AS counterpart FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND b.path = a.path GROUP BY a.chunk_id HAVING count(*) = 1""")
def version_counterparts(spark, d):
    o = table(spark, d, "orders")
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.array("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("section_path"))
    return evaluate.counterparts(chunks, o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_custkey") + 1).alias("other")).distinct())


@query("SELECT o_custkey AS case_id FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 97 = 0) > 0")
def changed_rankings(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.row_number().over(w).alias("rank"))
    return evaluate.changed_rankings(a, a.withColumn("item_id", F.when(F.col("item_id") % 97 == 0, -F.col("item_id") - 1).otherwise(F.col("item_id"))))


@query("""WITH q AS (SELECT item_id AS case_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS quote FROM benchmark), c AS (SELECT doc_id AS chunk_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM documents),
h AS (SELECT case_id, count(*) AS n, min(chunk_id) AS chunk_id FROM q JOIN c ON contains(c.text, q.quote) GROUP BY case_id) SELECT case_id, CASE WHEN n = 1 THEN chunk_id END AS chunk_id, n FROM h""")
def benchmark_gold(spark, d):
    """Items that stand in documents: all documents of the corpus are one document's chunks here."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit(0).alias("unit"), F.lit("corpus").alias("doc_id"), F.col("text").alias("quote"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("other").alias("doc_id"), "text")
    found = evaluate.holders(quotes, chunks)
    return found.groupBy("case_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).select("case_id", F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"), "n")


@query("SELECT o_custkey AS case_id, count(DISTINCT o_orderkey) AS n_runs, count(DISTINCT o_orderstatus) = 1 AS same_status, count(DISTINCT o_orderpriority) = 1 AS same_priority FROM orders GROUP BY o_custkey")
def facet_agreement(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return evaluate.agreement(runs, ("status", "priority"))


@query("""WITH u AS (SELECT event_id % 20 + 1 AS n_words, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 END AS trigger, event_type = 'click' AS required, CAST(user_id % 3000 AS BIGINT) AS ms FROM events), m AS (SELECT *, required AND trigger IS NOT NULL AS early, (n_words - trigger) * 400 AS lead FROM u)
SELECT count(*) AS utterances, count(*) FILTER (required) AS eligible, round(count(*) FILTER (early)::DOUBLE / count(*) FILTER (required), 4) AS early_rate, round(count(*) FILTER (early AND ms <= lead)::DOUBLE / count(*) FILTER (required), 4) AS done_rate, round(count(*) FILTER (NOT required AND trigger IS NOT NULL)::DOUBLE / count(*) FILTER (NOT required), 4) AS false_rate, round(avg(lead) FILTER (early), 1) AS mean_lead_ms FROM m""")
def early_rates(spark, d):
    e = F.col("event_id")
    ids = F.array(F.lit("a"))
    u = table(spark, d, "events").select((e % 20 + 1).alias("n_words"), F.when(e % 4 != 0, e % 7).alias("trigger"), (F.col("event_type") == "click").alias("required"), (F.col("user_id") % 3000).alias("retrieval_ms"), ids.alias("early_context"), ids.alias("final_context"))
    return evaluate.early_rates(evaluate.early_retrieval(u)).drop("mean_overlap")
