"""Sources and stores: document files, JSON and JSON-lines records, configuration tables, index and load checks."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from docquarry.functions.text import slug


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Letters without their accents (NFKD, what is not ASCII goes)."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def document_key(path: Column) -> Column:
    """A readable slug of the file's name and six digits of a hash of its relative path."""
    stem = without_accents(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    name = slug(stem)
    return F.concat(F.when(name == "", F.lit("document")).otherwise(name), F.lit("-"), F.substring(F.sha2(path, 256), 1, 6))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]", content: bool = False) -> DataFrame:
    """doc_id, relative_path, filename, size, sha256 (and content) of the files below a folder.

    Two files of the same doc_id are an error. Hashes are made where files are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = folder.split("://")[-1].replace("file:", "").rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), f"^.*?{root}", "")
    out = files.select(document_key(relative).alias("doc_id"), relative.alias("relative_path"), F.substring_index(relative, "/", -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))
    if not out.groupBy("doc_id").count().filter("count > 1").isEmpty():
        raise ValueError(f"files below {folder} share a doc_id")
    return out


def read_json(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file, those whose name begins with _ left out; the schema is given, never guessed."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(folder)


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Chunks by whether they are retrievable, sorted so that the same rows give the same files."""
    chunks.repartition("retrievable").sortWithinPartitions("retrievable", "doc_id", "ordinal").write.mode("overwrite").partitionBy("retrievable").json(folder)


def read_chunks(spark: SparkSession, folder: str, schema: StructType | str, excluded: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(folder).filter(F.col("retrievable") == (not excluded))


def toml_table(spark: SparkSession, path: str, section: str) -> DataFrame:
    """key, value of a section of a TOML file on the driver; tables as JSON."""
    with open(path, "rb") as f:
        rows = tomllib.load(f).get(section, {})
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str)) for k, v in rows.items()], "key string, value string")


def check_index(index: DataFrame, chunks: DataFrame) -> None:
    """An index must hold exactly the chunks, with their hashes (chunk_id, content_hash)."""
    key = ["chunk_id", "content_hash"]
    stale, missing = index.select(*key).join(chunks.select(*key), key, "left_anti"), chunks.select(*key).join(index.select(*key), key, "left_anti")
    if not stale.isEmpty() or not missing.isEmpty():
        raise ValueError(f"the index does not hold these chunks: {stale.count()} stale, {missing.count()} missing")


def load_tables(documents: DataFrame, chunks: DataFrame, folder: str, load_id: int) -> DataFrame:
    """Replaces both tables and appends a row to the loads; what was written is counted against what was given.

    Tables are written beside the old ones under the load's number; the row of the load, written last, is what makes
    them the current ones. So a load that fails leaves the former one in place.
    """
    spark = documents.sparkSession
    counts = []
    for name, df in (("documents", documents), ("chunks", chunks)):
        path = f"{folder}/{name}/load={load_id}"
        df.write.mode("overwrite").parquet(path)
        given, written = df.count(), spark.read.parquet(path).count()
        if given != written:
            raise ValueError(f"{name}: {written} of {given} rows were written")
        counts.append(written)
    spark.createDataFrame([(load_id, *counts)], "load_id long, n_documents long, n_chunks long").write.mode("append").parquet(f"{folder}/loads")
    return spark.read.parquet(f"{folder}/loads")


def current_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last load."""
    last = spark.read.parquet(f"{folder}/loads").agg(F.max("load_id").alias("n")).first().n
    if last is None:
        raise ValueError(f"nothing is loaded in {folder}")
    return spark.read.parquet(f"{folder}/{name}/load={last}")


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents as JSON, dealt out by their id, sorted, so that the same rows give the same files."""
    documents.repartition("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").json(folder)


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_excluded, first_id, last_id of chunks (doc_id, chunk_id, ordinal, retrievable)."""
    own = F.col("retrievable")
    return chunks.groupBy("doc_id").agg(F.count_if(own).alias("n_chunks"), F.count_if(~own).alias("n_excluded"), F.min_by("chunk_id", F.when(own, F.col("ordinal"))).alias("first_id"), F.max_by("chunk_id", F.when(own, F.col("ordinal"))).alias("last_id"))


#: Values of a document's row in the manifest.
MANIFEST = ("title", "organization", "domain", "document_type", "version", "effective_date", "revision_date", "issued_date", "source_url", "captured_at", "authority_level", "series_id", "superseded_date", "is_current")


def manifest_rows(documents: DataFrame, fields: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row a document (doc_id and its columns): the values of its fields (doc_id, field, value, source), null where they
    are unknown; missing_metadata names those; provenance maps the others to their sources; warnings and info are the codes
    of warnings (doc_id, code, severity)."""
    known = fields.filter(F.col("field").isin(*MANIFEST) & F.col("value").isNotNull())
    values = known.groupBy("doc_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in MANIFEST), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source")))).alias("provenance"))
    told = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("severity") != "info", F.col("code")))).alias("warnings"), F.array_sort(F.collect_set(F.when(F.col("severity") == "info", F.col("code")))).alias("info"))
    out = documents.join(values, "doc_id", "left").join(told, "doc_id", "left")
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in MANIFEST)))
    none = F.array().cast("array<string>")
    return out.withColumns({"missing_metadata": missing, "warnings": F.coalesce("warnings", none), "info": F.coalesce("info", none)})


#: Overrides that must quote evidence from the document, and those that must say what they are based on.
EVIDENCED = ("title", "organization", "version", "effective_date", "revision_date")
CURATED = ("domain", "document_type", "authority_level", "source_url", "captured_at", "series_id", "superseded_date", "is_current")


def checked_overrides(overrides: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, field, value, source; doc_id, field, reason) of overrides (doc_id, field, value, evidence, basis) and the texts
    of documents (doc_id, text): a fact must quote evidence that the text holds, whatever its case and spaces; a
    classification must give a basis, and its evidence, if there is any, is looked for too; is_current is true or false."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    seen = overrides.join(texts.select("doc_id", plain("text").alias("haystack")), "doc_id", "left")
    quote = plain(F.coalesce("evidence", F.lit("")))
    held = (quote != "") & F.coalesce(F.contains("haystack", quote), F.lit(False))
    fact = F.col("field").isin(*EVIDENCED)
    reason = (
        F.when(~fact & ~F.col("field").isin(*CURATED), "unknown field")
        .when(fact & ~held, "evidence not in document").when(~fact & (F.coalesce("basis", F.lit("")) == ""), "no basis given")
        .when(~fact & (quote != "") & ~held, "evidence not in document").when((F.col("field") == "is_current") & ~F.coalesce(F.col("value").isin("true", "false"), F.lit(False)), "must be true or false")
    )
    judged = seen.withColumn("reason", reason)
    return judged.filter("reason IS NULL").select("doc_id", "field", "value", F.when(fact, "override").otherwise("curated").alias("source")), judged.filter("reason IS NOT NULL").select("doc_id", "field", "reason")


def overrides_of(files: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their settings; filenames that settings name and no file has) of files (filename) and toml_table()."""
    both = files.join(settings.withColumnRenamed("key", "filename").withColumnRenamed("value", "settings"), "filename", "left")
    return both, settings.select(F.col("key").alias("filename")).join(files.select("filename"), "filename", "left_anti")


def save_index(vectors: DataFrame, chunks: DataFrame, folder: str, model: str) -> None:
    """Vectors (chunk_id, embedding) with the hashes of their chunks (chunk_id, content_hash) and the name of their model."""
    vectors.join(chunks.select("chunk_id", "content_hash"), "chunk_id").withColumn("model", F.lit(model)).write.mode("overwrite").parquet(folder)


def load_index(spark: SparkSession, folder: str, chunks: DataFrame, model: str) -> DataFrame:
    """chunk_id, content_hash, embedding of a stored index; an error if it is of another model or of other chunks."""
    index = spark.read.parquet(folder)
    other = index.filter(F.col("model") != model).limit(1).count()
    if other:
        raise ValueError(f"the index in {folder} is not of the model {model}")
    check_index(index, chunks)
    return index.drop("model")


def same_corpus(a: DataFrame, b: DataFrame) -> None:
    """Two indexes (chunk_id) that are fused must hold the same chunks."""
    if not a.select("chunk_id").exceptAll(b.select("chunk_id")).isEmpty() or not b.select("chunk_id").exceptAll(a.select("chunk_id")).isEmpty():
        raise ValueError("the indexes do not hold the same chunks")


def guard_snapshot(before: DataFrame, after: DataFrame) -> None:
    """An error if files (path, hash) changed, came or went between two snapshots."""
    from docquarry.operators.catalog import snapshot_difference

    changed = snapshot_difference(before, after).filter("status != 'unchanged'")
    if not changed.isEmpty():
        raise ValueError(f"files changed meanwhile: {[tuple(r) for r in changed.limit(5).collect()]}")


def migrate(spark: SparkSession, statements: dict[str, str], folder: str, run) -> list[str]:
    """Names of the migrations that were applied: statements (name -> text), whose names begin with a number, from 1 without
    gaps. What was applied is kept with its checksum in a folder; a statement that has changed or gone since is an error.
    run(text) applies one.
    """
    numbers = sorted((int(re.match(r"\d+", name)[0]), name) for name in statements)
    if [n for n, _ in numbers] != list(range(1, len(numbers) + 1)):
        raise ValueError("migrations must be numbered from 1 without gaps")
    sums = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in statements.items()}
    schema = "number int, name string, checksum string"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    applied = {r.name: r.checksum for r in spark.read.schema(schema).parquet(folder).collect()} if exists else {}
    if wrong := [name for name, checksum in applied.items() if sums.get(name) != checksum]:
        raise ValueError(f"migrations changed or missing: {', '.join(sorted(wrong))}")
    done = []
    for number, name in numbers:
        if name in applied:
            continue
        run(statements[name])
        spark.createDataFrame([(number, name, sums[name])], schema).coalesce(1).write.mode("append").parquet(folder)
        done.append(name)
    return done


SPANS = "doc_id string, page int, piece int, span int, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, chars array<struct<c: string, w: double>>"


def read_pdf(files: DataFrame) -> DataFrame:
    """Spans (SPANS) of PDF files (doc_id, content), for pages.lines_of_pages(). It needs a PDF library, which is an optional
    package; a table of spans from elsewhere does as well. A file that can't be read gives one row of page 0 without a
    font, whose chars say why; a page that can't be read gives none."""
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        import pymupdf

        schema = to_arrow_schema(_parse_datatype_string(SPANS))
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    pdf = pymupdf.open(stream=content, filetype="pdf")
                except Exception as e:  # a file that is broken is a row, not the end of the job
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "page": 0, "chars": [{"c": str(e), "w": 0.0}]}], schema=schema)
                    continue
                for number, page in enumerate(pdf, 1):
                    lines = [x for b in page.get_text("rawdict")["blocks"] for x in b.get("lines", [])]
                    rows = [
                        {"doc_id": doc_id, "page": number, "piece": i, "span": j, **dict(zip(("x0", "y0", "x1", "y1"), map(float, x["bbox"]))), "font": s["font"], "size": float(s["size"]), "flags": s["flags"], "chars": [{"c": c["c"], "w": c["bbox"][2] - c["bbox"][0]} for c in s["chars"]]}
                        for i, x in enumerate(lines)
                        for j, s in enumerate(x["spans"])
                    ]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, SPANS)
