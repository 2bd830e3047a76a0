"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read from memory-mapped sorted arrays.

Tokens are lower-cased (A-Z) words and one end token after each text, which is also what stands before the first word.

    p(w|u)  = (c(u,w) - D(c(u,w)))+ / c(u) + (D1 N1(u) + D2 N2(u) + D3 N3(u)) / c(u) * p(w)
    p(w)    = (n(w) - D'(n(w)))+ / n + (D1' m1 + D2' m2 + D3' m3) / n * 1 / (V + 1)

c(u,w) counts a bigram, c(u) all that begin with u, Nk(u) the different ones that were seen k times (3: at least), n(w)
the different words before w, n their sum, mk the words with n(w) = k, V the different tokens. The discounts are
Chen and Goodman's: Y = n1/(n1+2 n2), Dk = k - (k+1) Y n(k+1)/nk. A history that was never seen gives p(w).

Files of the model, in the shared folder. Each task writes one range of hash values, so that the files of a kind, one
after the other, are one sorted array:

    words-<range>    sorted hashes of tokens (uint64), counts (uint64)
    pairs-<range>    sorted hashes of bigrams (uint64), counts (uint8; 255: it is among the large ones)
    large-<range>    of the bigrams of a count of 255 or more: their places in the range (uint64), then their counts (uint64)
    stats-<range>    of each token of the range of that number: c(u), N1, N2, N3 as a history, n(w) (uint64 each)

A token's number is its place in the sorted array; the hash of a bigram mixes the two numbers and can be turned back.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import find_words, mix, offsets_of, row_slices, span_hashes, text_buffer
from .files import file_system, written
from .scratch import Scratch

_U = np.uint64
END_TOKEN = np.uint64(0x5BD1E995C0FFEE01)
#: Entries that a task holds before it sorts them, sums equal ones and hands them on.
HELD = 1 << 21
#: Ranges of hashes for each shuffle partition.
RANGES = 2
_BLOBS = "part int, hashes binary, counts binary"


def _unmix(x: np.ndarray) -> np.ndarray:
    """What mix() made x of."""
    def unshift(x, n):
        out = x
        for _ in range(64 // n):
            out = x ^ (out >> _U(n))
        return out

    x = unshift(x, 31) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = unshift(x, 27) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(x, 30)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes, and the sums of their counts."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash, of so many equal ones."""
    return ((hashes >> _U(32)) * _U(parts)) >> _U(32)


class _Counter:
    """Sums counts in a task; hands them on as a blob of sorted hashes for each range."""

    def __init__(self, parts: int):
        self.parts, self.hashes, self.counts, self.held = parts, [], [], 0

    def add(self, hashes: np.ndarray):
        values, counts = np.unique(hashes, return_counts=True)
        self.hashes.append(values)
        self.counts.append(counts.astype(np.int64))
        self.held += len(values)
        if self.held > HELD:
            merged = _summed(np.concatenate(self.hashes), np.concatenate(self.counts))
            self.hashes, self.counts, self.held = [merged[0]], [merged[1]], len(merged[0])
            if self.held > HELD // 2:
                yield from self.blobs()

    def blobs(self):
        if not self.held:
            return
        hashes, counts = _summed(np.concatenate(self.hashes), np.concatenate(self.counts))
        self.hashes, self.counts, self.held = [], [], 0
        cuts = np.searchsorted(_part(hashes, self.parts), np.arange(self.parts + 1))
        rows = [(p, _packed_hashes(hashes[a:b]), _packed_counts(counts[a:b])) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "hashes", "counts"])


def _packed_hashes(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").tobytes()


def _packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count below 255; the larger ones follow."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def _unpacked_counts(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hashes = [np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes")]
    counts = [_unpacked_counts(x.as_py(), len(h)) for x, h in zip(table.column("counts"), hashes)]
    return _summed(np.concatenate(hashes).astype(np.uint64), np.concatenate(counts))


def tokens(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, the end tokens included, and how many each text has."""
    data, offsets = text_buffer(rows.column("text"))
    starts, ends, counts = find_words(data, offsets)
    out = np.full(len(starts) + len(counts), END_TOKEN, np.uint64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = span_hashes(data, starts, ends, fold=True)
    return out, counts + 1


def _before(values: np.ndarray, counts: np.ndarray, end) -> np.ndarray:
    """What stands before each token: before a text's first one, the end token."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[offsets_of(counts)[:-1]] = end
    return out


@lru_cache(maxsize=512)
def _mapped(uri: str, kind: str, at: int, n: int) -> np.ndarray:
    """An array in a file: mapped into memory where the folder is mounted, else read."""
    if not n:
        return np.zeros(0, np.dtype(kind))
    fs, path = file_system(uri)
    if fs.type_name == "local":
        return np.memmap(path, np.dtype(kind), "r", at, (n,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, at), np.dtype(kind))


@lru_cache(maxsize=512)
def _large(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the bigrams of large counts."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        data = np.frombuffer(f.read(), "<u8").astype(np.int64)
    return data[: len(data) // 2], data[len(data) // 2 :]


class Sorted:
    """The sorted array that files of ranges make: finds hashes, and gives what stands beside them."""

    def __init__(self, folder: str, kind: str, sizes: list[int]):
        self.folder, self.kind, self.sizes, self.parts = folder, kind, sizes, len(sizes)
        self.base = offsets_of(np.array(sizes, np.int64))

    def hashes(self, part: int) -> np.ndarray:
        return _mapped(f"{self.folder}/{self.kind}-{part:06d}", "<u8", 0, self.sizes[part])

    def counts(self, part: int, at: np.ndarray) -> np.ndarray:
        """The counts that stand at places of a range."""
        n, name = self.sizes[part], f"{self.folder}/{self.kind}-{part:06d}"
        if self.kind == "words":
            return _mapped(name, "<u8", 8 * n, n)[at].astype(np.int64)
        out = _mapped(name, "u1", 8 * n, n)[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            places, counts = _large(f"{self.folder}/large-{part:06d}")
            out[large] = counts[np.searchsorted(places, at[large])]
        return out

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each sorted hash or -1, its count or 0)."""
        number, counts = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        cuts = np.searchsorted(_part(wanted, self.parts), np.arange(self.parts + 1))
        for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a == b or not self.sizes[p]:
                continue
            held = self.hashes(p)
            at = np.minimum(np.searchsorted(held, wanted[a:b]), len(held) - 1)
            good = held[at] == wanted[a:b]
            number[a:b][good] = at[good] + self.base[p]
            counts[a:b][good] = self.counts(p, at[good])
        return number, counts

    def stats(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of the five statistics of sorted token numbers."""
        out = np.zeros((len(numbers), 5), np.int64)
        cuts = np.searchsorted(numbers, self.base)
        for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a < b:
                rows = _mapped(f"{self.folder}/stats-{p:06d}", "<i8", 0, 5 * self.sizes[p]).reshape(-1, 5)
                out[a:b] = rows[numbers[a:b] - self.base[p]]
        return out


def _discounts(n: list[int]) -> np.ndarray:
    """D of a count of 0, 1, 2, and 3 or more, from how many things were seen once, twice, three and four times."""
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return np.array([0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])


class Model:
    """What a worker needs to score tokens."""

    def __init__(self, folder: str, words: list[int], pairs: list[int], train_tokens: int, seen: list[int], preceding: list[int]):
        self.words, self.pairs = Sorted(folder, "words", words), Sorted(folder, "pairs", pairs)
        self.n, self.v = train_tokens, sum(words)
        self.d, self.d1 = _discounts(seen), _discounts(preceding)
        self.n_pairs = sum(pairs)
        self.rest = float(self.d1[1] * preceding[0] + self.d1[2] * preceding[1] + self.d1[3] * (self.v - preceding[0] - preceding[1])) / max(1, self.n_pairs)

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score and the model's score (log10)."""
        wanted, inverse = np.unique(hashes, return_inverse=True)
        number, c = self.words.find(wanted)
        known = np.flatnonzero(number >= 0)
        stats = np.zeros((len(wanted), 5), np.int64)
        stats[known] = self.words.stats(number[known])
        preceded = stats[:, 4]
        lower = (np.maximum(preceded - self.d1[np.minimum(preceded, 3)], 0) / max(1, self.n_pairs)) + (self.rest if self.n_pairs else 1.0) / (self.v + 1)
        base = np.log10((c + 1) / (self.n + self.v + 1))
        end = np.searchsorted(wanted, END_TOKEN)
        before = _before(inverse, counts, end)
        key = np.where((number[inverse] >= 0) & (number[before] >= 0), 0, -1)
        pair = np.zeros(len(inverse), np.int64)
        both = np.flatnonzero(key == 0)
        if len(both):
            h, place = np.unique(pair_hashes(number[before[both]], number[inverse[both]]), return_inverse=True)
            pair[both] = self.pairs.find(h)[1][place]
        history = stats[before]
        total = history[:, 0]
        weight = (history[:, 1:4] * self.d[1:]).sum(1)
        seen = total > 0
        p = lower[inverse]
        total = np.maximum(total, 1)
        p = np.where(seen, np.maximum(pair - self.d[np.minimum(pair, 3)], 0) / total + weight / total * p, p)
        text = np.repeat(np.arange(len(counts)), counts)
        n = len(counts)
        return np.bincount(text, c[inverse] > 0, n).astype(np.int64), np.bincount(text, base[inverse], n), np.bincount(text, np.log10(p), n)


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix((before.astype(np.uint64) << _U(32)) | after.astype(np.uint64))


def _write_part(folder: str, kind: str, table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    part = table.column("part")[0].as_py()
    hashes, counts = _merged(table)
    with written(f"{folder}/{kind}-{part:06d}") as out:
        out.write(hashes.astype("<u8").tobytes())
        out.write(counts.astype("<u8").tobytes() if kind == "words" else np.minimum(counts, 255).astype(np.uint8).tobytes())
    if kind == "pairs":
        places = np.flatnonzero(counts >= 255)
        with written(f"{folder}/large-{part:06d}") as out:
            out.write(np.concatenate([places, counts[places]]).astype("<u8").tobytes())
    return part, hashes, counts


def train(texts: DataFrame, scratch: Scratch) -> Model:
    """Counts the texts of a DataFrame (column text) and writes the model's files.

    Every task sums what it has read before it hands it on, so that a frequent token or bigram is one entry of each
    task, and ranges of hash values are even. Only sizes and sums of ranges come to the driver.
    """
    spark = texts.sparkSession
    # a range is one task's: there are more of them than shuffle partitions, so that each is small
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch.root
    texts = texts.select("text")

    def count_words(batches):
        counter = _Counter(parts)
        for batch in batches:
            for rows in row_slices(batch, "text"):
                yield from counter.add(tokens(rows)[0])
        yield from counter.blobs()

    def write_words(table: pa.Table) -> pa.Table:
        part, hashes, counts = _write_part(folder, "words", table)
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(hashes)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    made = texts.mapInArrow(count_words, _BLOBS).groupBy("part").applyInArrow(write_words, "part int, n long, total long").collect()
    sizes = [0] * parts
    for r in made:
        sizes[r.part] = r.n
    total, v = sum(r.total for r in made), sum(sizes)
    if v >= 1 << 32:
        raise ValueError("more than 2**32 different tokens: a bigram's hash holds two numbers of 32 bits")
    base = offsets_of(np.array(sizes, np.int64))

    def count_pairs(batches):
        words, counter = Sorted(folder, "words", sizes), _Counter(parts)
        for batch in batches:
            for rows in row_slices(batch, "text"):
                hashes, counts = tokens(rows)
                wanted, inverse = np.unique(hashes, return_inverse=True)
                number = words.find(wanted)[0]
                end = number[np.searchsorted(wanted, END_TOKEN)]
                numbers = number[inverse]
                yield from counter.add(pair_hashes(_before(numbers, counts, end), numbers))
        yield from counter.blobs()

    def write_pairs(table: pa.Table) -> pa.Table:
        part, hashes, counts = _write_part(folder, "pairs", table)
        keys = _unmix(hashes)
        before, after = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
        seen = np.bincount(np.minimum(counts, 5), minlength=6)
        rows = [(-1, part, len(hashes), *(int(x) for x in seen[1:5]), b"", b"")]
        # what the range adds to the statistics of tokens, for each range of tokens
        order = np.argsort(before)
        u, first = np.unique(before[order], return_index=True)
        c = counts[order]
        sums = np.stack([np.add.reduceat(x, first) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))], 1)
        w, preceding = np.unique(after, return_counts=True)
        cut_u, cut_w = np.searchsorted(u, base), np.searchsorted(w, base)
        for p in range(parts):
            a, b, x, y = cut_u[p], cut_u[p + 1], cut_w[p], cut_w[p + 1]
            if a < b or x < y:
                rows.append((p, part, int(b - a), 0, 0, 0, 0, (u[a:b] - base[p]).astype("<u4").tobytes() + sums[a:b].astype("<u8").tobytes(), (w[x:y] - base[p]).astype("<u4").tobytes() + preceding[x:y].astype("<u8").tobytes()))
        names = ["part", "source", "n", "n1", "n2", "n3", "n4", "histories", "preceded"]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()))], names=names)

    schema = "part int, source int, n long, n1 long, n2 long, n3 long, n4 long, histories binary, preceded binary"
    gathered = scratch.table(texts.mapInArrow(count_pairs, _BLOBS).groupBy("part").applyInArrow(write_pairs, schema), "gathered")
    pair_sizes, seen = [0] * parts, [0] * 4
    for r in gathered.filter("part < 0").select("source", "n", "n1", "n2", "n3", "n4").collect():
        pair_sizes[r.source] = r.n
        seen = [x + y for x, y in zip(seen, r[2:])]

    def write_stats(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        out = np.zeros((sizes[part], 5), np.int64)
        for n, histories, preceded in zip(table.column("n").to_pylist(), table.column("histories"), table.column("preceded")):
            data = histories.as_py()
            out[np.frombuffer(data, "<u4", n), :4] += np.frombuffer(data, "<u8", offset=4 * n).astype(np.int64).reshape(n, 4)
            data = preceded.as_py()
            m = len(data) // 12
            out[np.frombuffer(data, "<u4", m), 4] += np.frombuffer(data, "<u8", offset=4 * m).astype(np.int64)
        with written(f"{folder}/stats-{part:06d}") as f:
            f.write(out.astype("<i8").tobytes())
        preceding = np.bincount(np.minimum(out[:, 4], 5), minlength=6)
        return pa.table({"part": pa.array([part], pa.int32())} | {f"n{k}": pa.array([int(preceding[k])], pa.int64()) for k in range(1, 5)})

    stats = gathered.filter("part >= 0").select("part", "n", "histories", "preceded").groupBy("part").applyInArrow(write_stats, "part int, n1 long, n2 long, n3 long, n4 long").collect()
    scratch.drop("gathered")
    preceding = [sum(r[k] for r in stats) for k in range(1, 5)]
    return Model(folder, sizes, pair_sizes, total, seen, preceding)


def score(documents: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Learns from the rows that are not held out (a boolean column), and scores all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text is the empty text, which
    has its end token only; repeated rows count as often as they are there and are all scored. A null held_out counts
    as false. Without training rows every token is unknown, and the model gives each the probability 1.
    """
    scratch = Scratch(documents.sparkSession, "lm")
    documents = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    model = train(documents.filter(~F.col("held_out")), scratch)

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch, "text"):
                hashes, counts = tokens(rows)
                known, base, own = model.score(hashes, counts)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(counts, pa.int64()), pa.array(known), pa.array(np.full(len(counts), model.n, np.int64)), pa.array(base), pa.array(own)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return documents.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def crc32_remainder(column, divisor: int):
    """crc32 of a value as text, modulo a number."""
    return F.crc32(column.cast("string").cast("binary")) % divisor
