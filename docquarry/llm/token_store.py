"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other:

    ids         blocks of 256 ids (the last one is filled up with its last id)
    lengths     blocks of 256 token counts of documents, made in the same way
    doc_ids     int64, little-endian; the first n_null of them stand for null
    starts      uint64: the byte at which each block begins, those of ids and then those of lengths
    footer      n_ids, n_docs, n_null, id blocks, length blocks, place of doc_ids, of starts: uint64 each; b"QPFR0001"

A block is: minimum (uint32), width (uint8), exceptions (uint16), then 256 values of width bits, little-endian, then
the exceptions' positions (uint8 each) and their values above the minimum (uint32 each). The width holds all but the
largest tenth of what is left when the minimum is subtracted; larger values are the exceptions.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import offsets_of, ranges, row_slices, text_buffer
from .files import file_system, written
from .pieces import PieceCoder
from .scratch import Scratch

BLOCK = 256
#: Of a block's values, this share must fit the width.
FITTING = 0.9
CHUNK_IDS = 1 << 19
#: Bytes of text that are encoded at once: of more text, fewer pieces are distinct.
ENCODED_BYTES = 1 << 22
MAGIC = b"QPFR0001"
_FOOTER = struct.Struct("<7Q8s")
_HEAD = 7


def _bits(x: np.ndarray) -> np.ndarray:
    """The bits that each number needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte at which each block begins) of uint32 values; the last block is filled up."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    short = -len(values) % BLOCK
    rows = np.concatenate([values, np.full(short, values[-1], np.uint32)]).astype(np.uint32).reshape(-1, BLOCK)
    least = rows.min(1)
    above = rows - least[:, None]
    nth = int(FITTING * BLOCK)
    width = _bits(np.partition(above, nth, axis=1)[:, nth])
    large = above.astype(np.uint64) >> width.astype(np.uint64)[:, None] > 0
    exceptions = large.sum(1)
    sizes = _HEAD + BLOCK // 8 * width + 5 * exceptions
    starts = offsets_of(sizes)
    out = np.zeros(int(starts[-1]), np.uint8)
    starts = starts[:-1]
    head = np.zeros((len(rows), _HEAD), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4] = width
    head[:, 5:7] = exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[starts[:, None] + np.arange(_HEAD)] = head
    kept = np.where(large, 0, above)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        whole = kept[at].astype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(whole.view(np.uint8), axis=1, bitorder="little").reshape(len(at), BLOCK, -1)[:, :, :w]
        out[(starts[at] + _HEAD)[:, None] + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    row, column = np.nonzero(large)
    if len(row):
        tail = starts + _HEAD + BLOCK // 8 * width
        nth_of_row = np.arange(len(row)) - np.repeat(offsets_of(exceptions)[:-1], exceptions)
        out[tail[row] + nth_of_row] = column
        place = tail[row] + exceptions[row] + 4 * nth_of_row
        out[place[:, None] + np.arange(4)] = above[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at starts."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(_HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    exceptions = np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    above = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        packed = data[(starts[at] + _HEAD)[:, None] + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        if w <= 16:
            bits = np.concatenate([bits, np.zeros((len(at), BLOCK, 16 - w), np.uint8)], axis=2)
            above[at] = np.packbits(bits, axis=2, bitorder="little").view("<u2")[:, :, 0]
        else:
            bits = np.concatenate([bits, np.zeros((len(at), BLOCK, 32 - w), np.uint8)], axis=2)
            above[at] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    if exceptions.any():
        tail = starts + _HEAD + BLOCK // 8 * width
        row = np.repeat(np.arange(len(starts)), exceptions)
        column = data[ranges(tail, exceptions)]
        nth_of_row = np.arange(len(row)) - np.repeat(offsets_of(exceptions)[:-1], exceptions)
        place = tail[row] + exceptions[row] + 4 * nth_of_row
        above[row, column] = np.ascontiguousarray(data[place[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return (above + least[:, None]).reshape(-1)


class TokenFileWriter:
    """Writes documents' ids in order, a chunk of blocks at a time."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.rest, self.lengths, self.doc_ids, self.n_null, self.n_ids = out, 0, [], [], [], [], 0, 0
        self.waiting = 0

    def _blocks(self, values: np.ndarray) -> None:
        data, starts = pack_blocks(values)
        self.out.write(data.tobytes())
        self.starts.append(starts + self.at)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.n_null += doc_ids.null_count
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy().astype("<i8"))
        self.lengths.append(lengths.astype(np.uint32))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= CHUNK_IDS:
            whole = np.concatenate(self.rest)
            most = len(whole) // BLOCK * BLOCK
            for a in range(0, most, CHUNK_IDS):
                self._blocks(whole[a : min(most, a + CHUNK_IDS)])
            self.rest, self.waiting = [whole[most:]], len(whole) - most

    def close(self) -> dict:
        self._blocks(np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32))
        id_blocks = sum(map(len, self.starts))
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.uint32)
        self._blocks(lengths)
        starts = np.concatenate(self.starts)
        doc_ids_at = self.at
        self.out.write(b"".join(x.tobytes() for x in self.doc_ids))
        starts_at = doc_ids_at + 8 * len(lengths)
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(_FOOTER.pack(self.n_ids, len(lengths), self.n_null, id_blocks, len(starts) - id_blocks, doc_ids_at, starts_at, MAGIC))
        return {"n_docs": len(lengths), "n_tokens": self.n_ids}


class TokenFile:
    """Reads a file; the index of block starts finds any id without reading what stands before it."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n_ids, self.n_docs, self.n_null, id_blocks, length_blocks, doc_ids_at, starts_at, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        starts = np.frombuffer(self.file.read_at(8 * (id_blocks + length_blocks), starts_at), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(self.file.read_at(8 * self.n_docs, doc_ids_at), "<i8")
        self.ends = np.append(starts[1:], doc_ids_at)
        self.starts, self.id_blocks = starts, id_blocks
        self.lengths = self._decoded(id_blocks, id_blocks + length_blocks)[: self.n_docs].astype(np.int64)

    def _decoded(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        low = int(self.starts[a])
        data = np.frombuffer(self.file.read_at(int(self.ends[b - 1]) - low, low), np.uint8)
        return unpack_blocks(data, self.starts[a:b] - low)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from the blocks that hold them."""
        a = start // BLOCK
        return self._decoded(a, min(self.id_blocks, -(-stop // BLOCK)))[start - a * BLOCK : stop - a * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, tokens before it in the file, its ids in parts)."""
        at, held_from, held = 0, 0, np.zeros(0, np.uint32)
        for i, n in enumerate(self.lengths.tolist()):
            parts, place, left = [], at, n
            while left:
                if not held_from <= place < held_from + len(held):
                    held_from = place // BLOCK * BLOCK
                    held = self.ids(held_from, min(self.n_ids, held_from + CHUNK_IDS))
                part = held[place - held_from : place - held_from + left]
                parts.append(part)
                place, left = place + len(part), left - len(part)
            yield None if i < self.n_null else int(self.doc_ids[i]), at, parts
            at += n

    def close(self) -> None:
        self.file.close()


@cache
def library_coder(path: str) -> tuple:
    """(tokenizer, special strings, coder of pieces) of a tokenizers file; kept by each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(pieces: list[bytes]) -> list[bytes]:
        out = []
        for a in range(0, len(pieces), 4096):
            some = [p.decode() for p in pieces[a : a + 4096]]
            made = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)  # one call for many pieces
            ids = np.array(made.ids, "<u4").tobytes()
            at = (4 * offsets_of(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))).tolist()
            out += [ids[x:y] for x, y in zip(at, at[1:])]
        return out

    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, special, PieceCoder(encode)


def encode_slice(rows: pa.RecordBatch, column: str, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text, its end id included, and how many."""
    tokenizer, special, coder = library_coder(path)
    data, offsets = text_buffer(rows.column(column))
    whole = data.tobytes()
    ids, counts = coder.ids(data, offsets)
    at = offsets_of(counts)
    if any(s.encode() in whole for s in special):  # the library gives these strings ids of their own
        parts = [ids[at[i] : at[i + 1]] for i in range(len(counts))]
        for i in range(len(counts)):
            text = whole[offsets[i] : offsets[i + 1]].decode()
            if any(s in text for s in special):
                parts[i] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        counts = np.array([len(p) for p in parts], np.int64)
        ids, at = np.concatenate(parts), offsets_of(counts)
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[ranges(at[:-1] + np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes texts and writes them as token files, in ascending order of their ids.

    Each task writes one file of a range of ids. A null text is the empty text and has its end id only. Null ids come
    first; rows with the same id are in order of their texts, so that repeated rows are all kept. An empty table
    writes no file. Returns the files: shard, uri, n_docs, n_tokens, start (of all files before).
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        shard, uri, made = TaskContext.get().partitionId(), "", {}
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is not None:
            uri = f"{folder}/shard-{shard:06d}.pfr"
            with written(uri) as out:
                writer = TokenFileWriter(out)
                for batch in chain([first], batches):
                    for rows in row_slices(batch, "text", ENCODED_BYTES):
                        writer.add(rows.column("doc_id"), *encode_slice(rows, "text", tokenizer, end_id))
                made = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri], "n_docs": pa.array([made["n_docs"]], pa.int64()), "n_tokens": pa.array([made["n_tokens"]], pa.int64())})

    # one row for each file, as many as there are tasks
    shards = sorted(ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_tokens long").collect())
    start, rows = 0, []
    for r in shards:
        rows.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "shard long, uri string, n_docs long, n_tokens long, start long")


def read_tokens(files: DataFrame) -> DataFrame:
    """Of each document in token files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian uint32)."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file, out = TokenFile(row["uri"]), []
                for doc_id, at, parts in file.documents():
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    out.append((doc_id, row["start"] + at, sum(map(len, parts)), crc))
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of documents in the shared folder and reads them back."""
    return read_tokens(write_tokens(documents, Scratch(spark, "tokens").root, tokenizer, end_id))
