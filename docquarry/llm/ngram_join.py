"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with the same set of word n-grams are one row of the incidence matrix. The product of the matrix with its
transpose counts the n-grams that two rows have in common; it is made in blocks of columns (n-grams), and only where
sizes leave a chance. N-grams are in one order for all rows, rare ones first (by counts over all documents in a fixed
number of buckets). For a threshold t and a set of n:

    two linked sets have k of their first n - ceil(t n) + k n-grams in common (or all they must have, if that is less),
    and for the smaller one these are among its first n - ceil(2 t n / (1 + t)) + k; the larger one is of at most n / t.

So the blocks hold these first columns only. Columns of few rows yield pairs, whose overlaps are accumulated over the
blocks; pairs of fewer than k are discarded. Columns of many rows, as copies make, yield all pairs of their rows that are
not of one component by then (linking.py) and whose sizes allow a link if this is the first n-gram that they have in
common. For the pairs that are left, the overlap over all columns is counted, and pairs below t (|a| + |b|) / (1 + t) are
discarded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import distinct_sorted, find_words, mix, offsets_of, row_slices, shingles, span_hashes, text_buffer
from .linking import link_groups
from .scratch import Scratch

#: Bits of the hashes that name a bucket of counts, and bits of the map below, for an input of up to SMALL_BYTES; for larger
#: ones up to MORE_BITS more, so that what is sent stays below 32 MB.
BUCKET_BITS, SMALL_BYTES, MORE_BITS = 20, 10 << 30, 3
#: N-grams that two linked sets must have in common among their first ones.
IN_COMMON = 3
#: Rows of a column whose pairs are all counted.
FEW_ROWS = 24
#: The map of the ids whose sets are needed has two to the power of so many bits; a foreign id that falls on one costs time only.
MAP_BITS = 24
_SLICES = 16
_U = np.uint64


def fixed_sums(made: DataFrame, size: int) -> np.ndarray:
    """Sums over all tasks of an array of a fixed size: made has rows (slice int, part binary: compressed uint32).

    Parts are summed in the tasks that read them and then by slice; what reaches the driver is of the fixed size.
    """
    width = size // _SLICES

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("part")):
                own = np.frombuffer(zlib.decompress(part.as_py()), "<u4").astype(np.uint64)
                held[k] = held[k] + own if k in held else own
        for k, own in held.items():
            yield _slice_batch(k, np.minimum(own, 0xFFFFFFFF))

    def final(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for part in table.column("part"):
            total += np.frombuffer(zlib.decompress(part.as_py()), "<u4")
        return pa.Table.from_batches([_slice_batch(table.column("slice")[0].as_py(), np.minimum(total, 0xFFFFFFFF))])

    out = np.zeros(size, np.uint32)
    for r in made.mapInArrow(summed, "slice int, part binary").groupBy("slice").applyInArrow(final, "slice int, part binary").collect():
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(zlib.decompress(r.part), "<u4")
    return out


def _slice_batch(k: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(values.astype("<u4").tobytes(), 1)], pa.binary())], names=["slice", "part"])


class SetReader:
    """Sets of hashed word n-grams of texts: their sorted distinct hashes, sizes, and a 64-bit name of each set."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = text_buffer(column)
        starts, ends, counts = find_words(data, offsets)
        flat, sizes = distinct_sorted(*shingles(span_hashes(data, starts, ends, fold=True), counts, self.n))
        at = offsets_of(sizes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return flat, sizes, mix(sums[at[1:]] - sums[at[:-1]] + mix(sizes.astype(np.uint64)))


def _more_bits(df: DataFrame) -> int:
    """Bits that are added for large inputs, by the size of the files that are read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MORE_BITS, max(0, (size // SMALL_BYTES).bit_length()))


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 16 bits that keeps their order at any size: their logarithms."""
    return np.minimum(np.floor(np.log2(counts.astype(np.float64) + 1) * 2047), 0xFFFF).astype(np.uint64)


def _ceil_share(n: np.ndarray, above: int, below: int) -> np.ndarray:
    return -(-(n * above) // below)


def link_documents(documents: DataFrame, n: int, percent: int, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of each row.

    Two rows link if 100 * |intersection| >= percent * |union| of their n-gram sets. A null or empty text, or one without
    words, has an empty set and links with nothing. Rows with the same text are of one component; rows are all kept. An
    id that is null takes no part in the smallest id; a row without id and without links has a null component.
    Other columns are not looked at. Sets are compared by 64-bit hashes of their n-grams, and named by a 64-bit hash.
    """
    read_sets = SetReader(n)
    own = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    low, high = percent, 100
    more = _more_bits(documents)
    buckets, shift = 1 << BUCKET_BITS + more, _U(64 - BUCKET_BITS - more)

    def first_pass(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in row_slices(batch, "text"):
                flat, sizes, names = read_sets(rows.column("text"))
                counts += np.bincount((flat >> shift).astype(np.int64), minlength=buckets)
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names.astype(np.int64), mask=sizes == 0), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["doc_id", "n_shingles", "node", "slice", "part"])
        width = buckets // _SLICES
        for k in range(_SLICES):
            b = _slice_batch(k, np.minimum(counts[k * width : (k + 1) * width], 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), b.column("slice"), b.column("part")], names=["doc_id", "n_shingles", "node", "slice", "part"])

    made = scratch.table(own.mapInArrow(first_pass, "doc_id long, n_shingles long, node long, slice int, part binary"), "sets", 2000)
    order = own.sparkSession.sparkContext.broadcast(fixed_sums(made.filter("part is not null").select("slice", "part"), buckets))
    sets = made.filter("part is null").select("doc_id", "n_shingles", "node")

    def second_pass(batches):
        counts = _rarity(order.value)
        for batch in batches:
            for rows in row_slices(batch, "text"):
                flat, sizes, names = read_sets(rows.column("text"))
                # one row of the matrix for each set that the batch holds
                _, once = np.unique(names, return_index=True)
                once = np.sort(once[sizes[once] > 0])
                at = offsets_of(sizes)
                key = (counts[(flat >> shift).astype(np.int64)] << _U(48)) | (flat >> _U(16))
                size = sizes[once]
                probe = np.minimum(size, size - _ceil_share(size, low, high) + IN_COMMON)
                index = size - _ceil_share(size, 2 * low, low + high) + IN_COMMON
                columns = [], []
                for i, p in zip(once.tolist(), probe.tolist()):
                    a, b = at[i], at[i + 1]
                    first = np.argpartition(key[a:b], p - 1)[:p] if p < b - a else np.arange(b - a)
                    first = first[np.argsort(key[a:b][first])]
                    columns[0].append(flat[a:b][first])
                    columns[1].append(np.arange(len(first)))
                if once.size:
                    lengths = np.array([len(x) for x in columns[0]])
                    place = np.concatenate(columns[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns[0]).astype(np.int64)), pa.array(np.repeat(names[once], lengths).astype(np.int64)), pa.array(np.repeat(size, lengths).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(place < np.repeat(index, lengths))], names=["tok", "node", "n", "pos", "ix"])

    postings = scratch.table(own.mapInArrow(second_pass, "tok long, node long, n int, pos int, ix boolean"), "postings", 2000)
    # columns that can yield no pair are most of them, as rare n-grams come first
    shared = postings.groupBy("tok").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("ix").alias("ix")).filter("lo != hi and ix").select("tok")
    postings = scratch.table(postings.join(shared, "tok", "left_semi").distinct(), "shared", small=True)
    scratch.drop("postings")

    sizes = postings.groupBy("tok").agg(F.count("*").alias("rows"))
    few = postings.join(sizes.filter(F.col("rows") <= FEW_ROWS).select("tok"), "tok", "left_semi")
    many = scratch.table(postings.join(sizes.filter(F.col("rows") > FEW_ROWS).select("tok"), "tok", "left_semi"), "many", small=True)
    in_many = many.groupBy("node").agg(F.count("*").alias("g"))
    a = few.filter("ix").select("tok", F.col("node").alias("a"), F.col("n").alias("na"))
    b = few.select("tok", F.col("node").alias("b"), F.col("n").alias("nb"))
    product = a.join(b, "tok").filter(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("nb") * low <= F.col("na") * high))
    overlaps = product.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("na").alias("na"))
    # what a pair may have in common in columns of many rows is not counted, so it is taken as if it were there
    overlaps = overlaps.join(in_many.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a", "left").join(in_many.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b", "left")
    k = F.col("k") + F.least(F.coalesce("ga", F.lit(0)), F.coalesce("gb", F.lit(0)))
    pairs = scratch.table(overlaps.filter((k >= IN_COMMON) | (k >= F.ceil(F.col("na") * low / high))).select("a", "b"), "pairs", small=True)
    many = many.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * low / high)).select("tok", "node", "n", "pos")

    def may_link(n: Column, pos: Column, m: Column, other: Column) -> Column:
        overlap = F.ceil((n + m) * low / (low + high))
        return (n - pos >= overlap) & (m - other >= overlap)

    names = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct()
    needed = names.join(wanted, "node", "left_semi").select("first_id")
    rows = scratch.table(_needed_sets(own, needed, read_sets, scratch, 1 << MAP_BITS + more), "rows", 2000, small=True)

    def verify(pairs: DataFrame) -> DataFrame:
        a = rows.select(F.col("node").alias("a"), F.col("members").alias("ma"))
        b = rows.select(F.col("node").alias("b"), F.col("members").alias("mb"))

        def count(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("ma"), batch.column("mb")):
                    p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    both = np.sort(np.concatenate([p, q]))
                    overlap = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * overlap >= percent * (len(p) + len(q) - overlap))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(a, "a").join(b, "b").select("a", "b", "ma", "mb").mapInArrow(count, "a long, b long")

    comp = link_groups(many, verify, scratch, "links", may_link, pairs)
    comp = scratch.table(comp, "components", small=True)
    named = names.join(comp, "node", "left").select("node", "first_id", F.coalesce("c", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    of_node = scratch.table(named.join(least, "c").select("node", "component_id"), "of_node", small=True)
    return sets.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, n: int, percent: int, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, of which one stays for each component: the first by id, ties by a hash
    of the text.

    A row without id comes last. Rows of the same id and text are one document, of which one row stays; rows of the same id
    and different texts are different documents. A null text, an empty one and one without words have no near copies:
    they all stay but for rows that are repeated.
    """
    # a row is one value, so that its columns may have any names
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole")
    text, own = F.col(text_column).cast("string"), F.col(id_column).cast("long")
    keyed = documents.select(whole, F.xxhash64(own, text, F.lit(n)).alias("key"), own.isNull().alias("last"), own.alias("id"), text.alias("text"))
    linked = link_documents(keyed.select("key", "text"), n, percent, scratch, "key", "text").select(F.col("doc_id").alias("key"), "component_id").distinct()
    places = keyed.select("key", F.struct("last", "id", "key").alias("place")).distinct()
    first = linked.join(places, "key").groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.key").alias("key"))
    kept = keyed.join(first, "key", "left_semi").select("key", "whole")
    if not keyed.groupBy("key").count().filter("count > 1").isEmpty():
        # rows of one id and text differ in other columns at most
        order = Window.partitionBy("key").orderBy(F.xxhash64("whole"))
        kept = kept.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return kept.select(*(F.col("whole").getField(c).alias(c) for c in documents.columns))


def _needed_sets(own: DataFrame, needed: DataFrame, read_sets: SetReader, scratch: Scratch, size: int) -> DataFrame:
    """node, members of the rows whose id is needed: they are found by a map of bits, so that texts are not shuffled."""

    def bits(batches):
        held = np.zeros(size // 32, np.uint32)
        for batch in batches:
            at = _bit(batch.column("first_id").fill_null(-1).to_numpy(), size)
            np.bitwise_or.at(held, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], names=["part"])

    def either(batches):
        held = np.zeros(size // 32, np.uint32)
        for batch in batches:
            for part in batch.column("part"):
                held |= np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], names=["part"])

    total = np.zeros(size // 32, np.uint32)
    # written between, so that no task holds two Python workers
    made = scratch.table(needed.mapInArrow(bits, "part binary"), "bits", small=True)
    for r in made.coalesce(4).mapInArrow(either, "part binary").collect():
        total |= np.frombuffer(zlib.decompress(r.part), np.uint32)
    sent = own.sparkSession.sparkContext.broadcast(total)

    def run(batches):
        for batch in batches:
            at = _bit(batch.column("doc_id").fill_null(-1).to_numpy(), size)
            batch = batch.filter(pa.array((sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            for rows in row_slices(batch, "text"):
                flat, sizes, names = read_sets(rows.column("text"))
                at = offsets_of(sizes).tolist()
                keep = [i for i, s in enumerate(sizes.tolist()) if s]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(names[keep].astype(np.int64)), pa.array([flat[at[i] : at[i + 1]].astype("<u8").tobytes() for i in keep], pa.binary())], names=["node", "members"])

    return own.mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def _bit(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).astype(np.uint64)) % _U(size)).astype(np.int64)
