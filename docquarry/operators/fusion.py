"""Dense search, reciprocal-rank fusion, rerank pools and the merging of ranked lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, DEPTH, POOL = 60, 100, 20


#: Bytes of stated queries that are sent to the tasks at most; more are asked in several passes.
SENT_BYTES = 64 << 20
#: Scores that a task makes at once.
BLOCK = 1 << 21


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the best k vectors (vec_id, embedding) of each stated query (query_id, embedding) by
    cosine of unit vectors, that is their dot product (double, rounded to 6); ties by id.

    Queries are a matrix that each task multiplies with the batches that it reads, so many queries at once that there
    are BLOCK scores; it keeps the best k of each query, so that k rows a query and task are shuffled. More queries than SENT_BYTES hold are asked in passes.
    """
    import numpy as np
    import pyarrow as pa

    size = queries.select(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    none = queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    passes = -(-size.n * (size.d or 1) * 8 // SENT_BYTES)
    parts = []
    for p in range(passes):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else queries
        rows = own.filter("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding").toArrow().combine_chunks()
        ids = rows.column("query_id").to_numpy()
        if not len(ids):
            continue
        wanted = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        matrix = queries.sparkSession.sparkContext.broadcast((ids, wanted))

        def run(batches, matrix=matrix):
            asked, wanted = matrix.value
            # places that are not taken come after all that may be
            best_id = np.full((len(asked), k), np.iinfo(np.int64).max)
            best = np.full((len(asked), k), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = batch.column("embedding")
                data = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
                own = batch.column("vec_id").to_numpy()
                some = max(1, BLOCK // len(own))
                for i in range(0, len(asked), some):
                    scores = np.round(wanted[i : i + some] @ data.T, 6)
                    if np.isnan(scores.sum()):
                        scores[np.isnan(scores)] = np.inf
                    limit = best[i : i + some, -1:]
                    if len(own) > k and np.count_nonzero(scores >= limit) > 2 * k * len(scores):
                        limit = np.maximum(limit, np.partition(scores, len(own) - k, axis=1)[:, [len(own) - k]])
                    q, at = np.nonzero(scores >= limit)
                    changed, which = np.unique(q, return_inverse=True)
                    flat = np.concatenate([np.repeat(np.arange(len(changed)), k), which])
                    value = np.concatenate([best[i + changed].ravel(), scores[q, at]])
                    name = np.concatenate([best_id[i + changed].ravel(), own[at]])
                    order = np.lexsort((name, -value, flat))
                    first = np.searchsorted(flat[order], np.arange(len(changed)))
                    chosen = order[first[:, None] + np.arange(k)]
                    best[i + changed], best_id[i + changed] = value[chosen], name[chosen]
            n = int((best > -np.inf).any(axis=0).sum())
            best, best_id = np.where(best[:, :n] == np.inf, np.nan, best[:, :n]), best_id[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(best_id.ravel()), pa.array(best.ravel())], names=["query_id", "vec_id", "score"])

        parts.append(vectors.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double"))
    return ranked(reduce(DataFrame.unionByName, parts) if parts else none, k, "vec_id")


def embedded(passages: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "", batch: int = 16) -> DataFrame:
    """item_id, embedding (unit vectors, float) of passages (item_id, text). load() makes the model, once for each task;
    the model turns a list of texts into vectors. prefix: what the model's card puts before a passage or a query."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = load()
        for rows in batches:
            texts = [prefix + (t or "") for t in rows.column("text").to_pylist()]
            made = [np.asarray(model(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            if not made:
                continue
            vectors = np.concatenate(made)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], names=["item_id", "embedding"])

    return passages.select("item_id", "text").mapInArrow(run, f"item_id {passages.schema['item_id'].dataType.simpleString()}, embedding array<float>")


def pair_scores(pairs: DataFrame, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16) -> DataFrame:
    """query_id, item_id, score of pairs (query_id, item_id, query, text) by a model of pairs, made once for each task."""
    def run(batches):
        import pyarrow as pa

        model = load()
        for rows in batches:
            both = list(zip(rows.column("query").to_pylist(), rows.column("text").to_pylist()))
            scores = [float(s) for i in range(0, len(both), batch) for s in model(both[i : i + batch])]
            yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("item_id"), pa.array(scores, pa.float64())], names=["query_id", "item_id", "score"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "item_id"))
    return pairs.select("query_id", "item_id", "query", "text").mapInArrow(run, f"{kinds}, score double")


# Embedding models that may be used, with what stands before passages and queries.
MODELS = {
    "arctic-m": ("", "Represent this sentence for searching relevant passages: "),
    "bge-base": ("", "Represent this sentence for searching relevant passages: "),
    "bge-small": ("", "Represent this sentence for searching relevant passages: "),
    "e5-base": ("passage: ", "query: "),
    "minilm-l6": ("", ""),
    "nomic-v1.5": ("search_document: ", "search_query: "),
    "mxbai-large": ("", "Represent this sentence for searching relevant passages: "),
}


def ranked(scored: DataFrame, k: int, id_column: str) -> DataFrame:
    """The best k of each query by score, ties by id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_column))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def rrf(rankings: list[DataFrame], k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """query_id, item_id, score, best_rank, rank: sums of 1 / (k + rank) over lists (query_id, item_id, rank) up to a depth.

    Ties go by the best rank in any list, then by the item.
    """
    every = reduce(DataFrame.unionByName, (r.select("query_id", "item_id", "rank").filter(F.col("rank") <= depth) for r in rankings))
    fused = every.groupBy("query_id", "item_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "best_rank", "item_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def rerank(pool: DataFrame, scorer: Callable[[DataFrame], DataFrame], size: int = POOL) -> DataFrame:
    """The first rows of a ranking by a scorer's score (query_id, item_id, score), ties by their rank before.

    The pool is cut first; the scorer sees nothing else.
    """
    first = pool.filter(F.col("rank") <= size).select("query_id", "item_id", F.col("rank").alias("before"))
    scored = first.join(scorer(first.select("query_id", "item_id")), ["query_id", "item_id"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "before")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def jaccard_of(x: Column, y: Column) -> Column:
    """Similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def round_robin(runs: DataFrame) -> DataFrame:
    """query_id, item_id, intent, depth, rank of lists (query_id, intent, item_id, rank): one of each list in turn.

    The depth of an item is its place in its list, whatever its rank says; an item that comes again is left out there.
    """
    place = Window.partitionBy("query_id", "intent").orderBy("rank", "item_id")
    placed = runs.withColumn("depth", F.row_number().over(place).cast("long"))
    first = placed.groupBy("query_id", "item_id").agg(F.min(F.struct("depth", "intent")).alias("first"), F.array_sort(F.collect_set("intent")).alias("intents"))
    order = Window.partitionBy("query_id").orderBy("first.depth", "first.intent")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "item_id", F.col("first.intent").alias("intent"), F.col("first.depth").alias("depth"), "rank", F.array_join(F.col("intents").cast("array<string>"), ",").alias("intents"))


def associated(entries: DataFrame) -> DataFrame:
    """The intents that an item belongs to, of (query_id, item_id, intent, score): those that score 0 or more; if none does,
    all that have the best score; all of them if any has no score."""
    w = Window.partitionBy("query_id", "item_id")
    seen = entries.withColumn("best", F.max("score").over(w)).withColumn("unknown", F.count_if(F.col("score").isNull()).over(w) > 0)
    return seen.filter(F.col("unknown") | (F.col("score") >= 0) | ((F.col("best") < 0) & (F.col("score") == F.col("best")))).select("query_id", "item_id", "intent", "score")


def merge_rounds(rounds: DataFrame, k: int) -> DataFrame:
    """The best k items over rounds (query_id, round, item_id, rank, score): each once, as it was first seen.

    Order: score, then where it was first seen.
    """
    first = rounds.groupBy("query_id", "item_id").agg(F.min(F.struct("round", "rank", "score")).alias("f"))
    order = Window.partitionBy("query_id").orderBy(F.col("f.score").desc_nulls_last(), "f.round", "f.rank", "item_id")
    return first.withColumn("merged_rank", F.row_number().over(order).cast("long")).filter(F.col("merged_rank") <= k).select("query_id", "item_id", F.col("f.round").alias("round"), F.col("f.rank").alias("rank"), F.col("f.score").alias("score"), "merged_rank")
