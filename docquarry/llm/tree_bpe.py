"""Byte-level BPE as a monoid: texts are encoded in halves, and neighbours are joined at their boundary.

An element is an encoded stretch of bytes. Two facts make the join of neighbours exact:

* A sequence of tokens is what the merges make of its bytes if and only if that holds for each two adjacent tokens. So
  a boundary window may be encoded anew by itself: as soon as its first token stands well beside the token to its left
  and its last one beside the token to its right, nothing outside can change. Else the window grows.
* The pattern that cuts text into pieces is matched from left to right without looking back. So matches of the right
  element stay what they are from the first place at which the window's matches and its own begin at the same byte;
  matches of the left element are fixed if they end, with the characters that they look at, before its end.

Decoding joins the bytes of the halves.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import offsets_of, release_memory, row_slices, text_buffer
from .files import file_system
from .pieces import PieceCoder, split_pieces

#: Bytes of a piece that are merged directly, without halves.
LEAF_BYTES = 32
#: Bytes of a text that are cut into pieces at once, without halves.
LEAF_TEXT = 1 << 16
#: Tokens on each side of the first window that is encoded anew.
WINDOW = 4


class TreeBpe:
    """Ids of byte strings by ranks; as in the public rank files, a pair may merge if its bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens, self.stable = ranks, {i: b for b, i in ranks.items()}, {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost of equals, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(piece[i : i + 2], 1 << 40) for i in range(len(piece) - 1)]
        while scores:
            best = min(scores)
            if best == 1 << 40:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
        return [ranks[p] for p in parts]

    def beside(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when they meet."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > 1 << 19:
                self.stable.clear()
            known = self.stable[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of two stretches of one piece that follow one another."""
        if not a or not b or self.beside(a[-1], b[0]):
            return a + b
        left = right = WINDOW
        while True:
            i, j = max(0, len(a) - left), min(len(b), right)
            middle = self.small(b"".join(map(self.tokens.__getitem__, a[i:] + b[:j])), left + right)
            good_left = i == 0 or self.beside(a[i - 1], middle[0])
            good_right = j == len(b) or self.beside(middle[-1], b[j])
            if good_left and good_right:
                return a[:i] + middle + b[j:]
            left, right = left * (1 if good_left else 2), right * (1 if good_right else 2)

    def small(self, piece: bytes, tokens: int) -> list[int]:
        """A window is merged directly while it is of a few tokens; a larger one in halves again."""
        return self.leaf(piece) if tokens <= 8 * WINDOW or len(piece) <= LEAF_BYTES else self.encode_piece(piece)

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        return [np.array(self.encode_piece(p), "<u4").tobytes() for p in pieces]


class TreeText:
    """Pieces of a text by halves. An element is its pieces' byte starts; pieces are encoded once they are final."""

    def __init__(self, leaf: int = LEAF_TEXT):
        self.leaf = max(leaf, 8)  # a cut is moved by at most three bytes

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Where the matches of the pattern begin in one text."""
        if len(data) <= self.leaf:
            return split_pieces(data, np.array([0, len(data)], np.int64))[0]
        half = len(data) // 2
        while (data[half] & 0xC0) == 0x80:
            half -= 1
        return self.join(data, self.starts(data[:half]), half, self.starts(data[half:]) + half)

    def join(self, data: np.ndarray, a: np.ndarray, half: int, b: np.ndarray) -> np.ndarray:
        """The last three matches of the left element may look beyond its end; from there, the window is matched anew."""
        left, right = 3, 4
        i = max(0, len(a) - left)
        low = int(a[i]) if len(a) else 0
        while True:
            j = min(len(b), right)
            high = int(b[j]) if j < len(b) else len(data)
            made = split_pieces(data[low:high], np.array([0, high - low], np.int64))[0] + low
            if j == len(b):
                return np.concatenate([a[:i], made])
            # matches of the window that end before its last three are fixed, as are those of the right element
            met = np.intersect1d(made[:-3], b[:j])
            if len(met):
                return np.concatenate([a[:i], made[made < met[0]], b[b >= met[0]]])
            right *= 2


@cache
def rank_coder(uri: str) -> tuple[TreeBpe, PieceCoder]:
    """Of a rank file (a line: base64 of a token's bytes, its rank); kept by each Python worker."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        lines = f.read().splitlines()
    bpe = TreeBpe({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x)})
    return bpe, PieceCoder(bpe.encode_pieces)


@cache
def token_bytes(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes by id, one after the other: bytes, starts, sizes."""
    bpe, _ = rank_coder(uri)
    every = [bpe.tokens.get(i, b"") for i in range(max(bpe.tokens, default=-1) + 1)]
    sizes = np.array([len(x) for x in every], np.int64)
    return np.frombuffer(b"".join(every), np.uint8), offsets_of(sizes)[:-1], sizes


def encode_texts(data: np.ndarray, offsets: np.ndarray, uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts and how many each has: short texts are leaves that are cut together, longer ones are trees."""
    _, coder = rank_coder(uri)
    sizes = np.diff(offsets)
    if len(sizes) and sizes.max() > LEAF_TEXT:
        tree, starts, counts = TreeText(), [], []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = tree.starts(data[low:high]) + low
            starts.append(own)
            counts.append(len(own))
        starts, counts = np.concatenate(starts), np.array(counts, np.int64)
        ends = np.append(starts[1:], len(data))
    else:
        starts, ends, counts = split_pieces(data, offsets)
    ids, sizes = coder.piece_ids(data, starts, ends)
    return ids, np.diff(offsets_of(sizes)[offsets_of(counts)])


def decode(ids: np.ndarray, uri: str, leaf: int = 1 << 16) -> bytes:
    """The bytes of ids: those of the halves, one after the other."""
    if len(ids) > leaf:
        half = len(ids) // 2
        return decode(ids[:half], uri, leaf) + decode(ids[half:], uri, leaf)
    from .arrowtext import ranges

    data, starts, sizes = token_bytes(uri)
    return data[ranges(starts[ids], sizes[ids])].tobytes()


#: What encode_documents() can return of each text besides its id.
COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(documents: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Encodes each text and, where it is asked for, decodes it again: doc_id and the columns that are named.

    n_tokens, ids, decoded (the bytes of the ids), ids_sha256 (of the ids as little-endian uint32) and decoded_sha256. Only
    what is named is made; by default the first three, with digest n_tokens and the hashes. A null text is the empty text, which has no ids. Rows are kept as they are, repeated ones
    included; other columns are not looked at, whatever their names. No shuffle: each row is worked on where it is read,
    a megabyte of text at once or one text.
    """
    columns = columns or (("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("n_tokens", "ids", "decoded"))

    def column(name: str, ids: np.ndarray, counts: np.ndarray, own: list[np.ndarray]) -> pa.Array:
        if name == "n_tokens":
            return pa.array(counts, pa.int64())
        if name == "ids":
            return pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), pa.array(ids.view(np.int32)))
        if name == "ids_sha256":
            return pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string())
        if name == "decoded":
            return pa.array([decode(x, ranks) for x in own], pa.binary())
        return pa.array([hashlib.sha256(decode(x, ranks)).hexdigest() for x in own], pa.string())

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch, "text"):
                ids, counts = encode_texts(*text_buffer(rows.column("text")), ranks)
                at = offsets_of(counts).tolist()
                own = [ids[a:b] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(column(c, ids, counts, own) for c in columns)], names=["doc_id", *columns])
        # a worker that Spark keeps for later tasks gives up what it knows of pieces
        rank_coder(ranks)[1].forget()
        release_memory()

    schema = ", ".join(["doc_id long", *(f"{c} {COLUMNS[c]}" for c in columns)])
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)
