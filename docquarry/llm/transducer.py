"""Token counts by a finite-state transducer that is compiled from a BPE vocabulary with word ends.

Symbols are the bytes of words; a word's last byte is a symbol of its own kind (256 + byte). What the merges make of a
word is the one sequence of tokens of which each two adjacent ones stay as they are when they meet. So the transducer
reads a word from left to right and keeps, for each place from which a token may still be under way, the node of that
token in the vocabulary's trie, the token before it, and how many tokens there were against now. Such a set is a state:
there are finitely many, since tokens are of bounded length. A transition is annotated with the count that it emits
(tokens of the word so far, less those before the symbol; it may be negative, when a symbol makes tokens one). The
symbol at a word's end leads back to the start state. States and transitions are compiled when text first needs them
and are kept, up to a bound, in a hash table that numpy looks up for many chunks at once.

A batch of texts is one string of symbols, cut into chunks of equal length, which are read side by side from the start
state. A chunk's map from the state before it to the state after it is constant if a word ends in it: that state is
known after the first reading. A prefix scan over the chunks composes the maps: a running maximum finds the last
constant one before each chunk; where words run through whole chunks, the maps between are composed one after the
other. Then each chunk's head, up to its first word end, is read again from the state that the scan gave.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import row_slices
from .files import file_system
from .pieces import NUMBER, SPACE, code_point_classes, code_points

CHUNK = 512
END = 256
_EMPTY = np.int64(-1)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Compiled step by step from the vocabulary and the merges of a BPE model whose words end in a suffix."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = "</w>", most: int = 1 << 20):
        letters = byte_alphabet()
        self.merges, self.most = {}, most
        named: dict[tuple[int, ...], int] = {}
        of_name = {}
        for name, i in vocabulary.items():
            body, ends = (name[: -len(suffix)], True) if name.endswith(suffix) and len(name) > len(suffix) else (name, False)
            if all(c in letters for c in body):
                symbols = tuple(letters[c] for c in body)
                symbols = (*symbols[:-1], symbols[-1] + END) if ends else symbols
                named[symbols] = i
                of_name[name] = i
        self.symbols = {i: s for s, i in named.items()}
        self.named = named
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a in of_name and b in of_name and a + b in of_name:
                self.merges[of_name[a], of_name[b]] = rank, of_name[a + b]
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for symbols, i in named.items():
            node = 0
            for x in symbols:
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][x]
            self.token[node] = i
        self.stable: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the table of states and transitions."""
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.size = 0
        self._room(1 << 16)

    def _room(self, capacity: int) -> None:
        self.shift = np.uint64(64 - capacity.bit_length() + 1)
        self.mask = np.int64(capacity - 1)
        self.keys = np.full(capacity, _EMPTY)
        self.next = np.zeros(capacity, np.int32)
        self.emits = np.zeros(capacity, np.int8)

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """The tokens that the merges make of symbols: the lowest rank first, the leftmost of equals."""
        parts = [self.named[(x,)] for x in symbols]
        while len(parts) > 1:
            ranks = [self.merges.get(p, (1 << 40, 0)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best[0] == 1 << 40:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [best[1]]
        return parts

    def beside(self, a: int, b: int) -> bool:
        """Whether token b stands as it is after token a (-1: at a word's begin)."""
        known = self.stable.get((a, b))
        if known is None:
            known = self.merged(self.symbols[b]) == [b] if a < 0 else self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
            if len(self.stable) > self.most:
                self.stable.clear()
            self.stable[a, b] = known
        return known

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, emitted count) of a transition."""
        under_way, found = [], None
        for node, before, less in self.states[state]:
            node = self.child[node].get(symbol)
            if node is None:
                continue
            token = self.token[node]
            if found is None and token >= 0 and self.beside(before, token):
                found = token, less + 1
            under_way.append((node, before, less))
        token, emitted = found
        if symbol >= END:
            return 0, emitted
        after = ((0, token, 0), *((n, b, less - emitted) for n, b, less in under_way if self.child[n]))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], emitted

    def _place(self, key: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or the empty place where it belongs."""
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[at]
        wrong = np.flatnonzero((held != key) & (held != _EMPTY))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            held = self.keys[at[wrong]]
            wrong = wrong[(held != key[wrong]) & (held != _EMPTY)]
        return at

    def _grow(self) -> None:
        keys, nexts, emits = (x[self.keys != _EMPTY] for x in (self.keys, self.next, self.emits))
        self._room(2 * (int(self.mask) + 1))
        for k, n, e in zip(keys, nexts, emits):
            self._put(int(k), int(n), int(e))

    def _put(self, key: int, state: int, emitted: int) -> None:
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> int(self.shift)
        while self.keys[at] != -1:
            at = (at + 1) & int(self.mask)
        self.keys[at], self.next[at], self.emits[at] = key, state, emitted

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of each chunk."""
        key = state.astype(np.int64) * 512 + symbol
        at = self._place(key)
        missing = self.keys[at] != key
        if missing.any():
            for k in np.unique(key[missing]).tolist():
                self._put(k, *self.compiled(k >> 9, k & 511))
                self.size += 1
                if self.size > int(self.mask) // 2:
                    self._grow()
            at = self._place(key)
        return self.next[at], self.emits[at]

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """The count that each symbol emits; the last symbol ends a word."""
        if self.size > self.most:
            self.forget()
        n = len(symbols)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, symbols[-1] if n else 0, np.int16)
        padded[:n] = symbols
        by_place = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        out = np.zeros((CHUNK, chunks), np.int8)
        path = np.zeros((CHUNK + 1, chunks), np.int32)
        for t in range(CHUNK):
            path[t + 1], out[t] = self.step(path[t], by_place[t])
        self._compose(by_place, out, path)
        return out.T.reshape(-1)[:n]

    def _compose(self, by_place: np.ndarray, out: np.ndarray, path: np.ndarray) -> None:
        """The prefix scan over the chunks' maps, each of which was read from state 0.

        Composing two neighbouring maps asks the second one for the state that the first one ends in. All neighbours are
        composed at once. A chunk that is asked for another state is read again up to the place at which the paths from
        both states meet, as they do soon: from there on its map is the same, so that its own end and all that was
        composed after it stand. Only where paths do not meet within a chunk, its neighbour is composed again; what such a
        map gives for a state is kept, as chunks of a text that repeats itself are alike. It ends when no end changes.
        """
        entry = np.zeros(path.shape[1], np.int32)
        known: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            wanted = np.concatenate([[0], path[-1, :-1]]).astype(np.int32)
            again = np.flatnonzero(wanted != entry)
            if not len(again):
                return
            entry[again] = wanted[again]
            if known:
                fresh = []
                for c in again.tolist():
                    if (made := known.get((by_place[:, c].tobytes(), int(entry[c])))) is None:
                        fresh.append(c)
                    else:
                        out[:, c], path[:, c] = made
                again = np.array(fresh, np.int64)
            state = entry[again]
            path[0, again] = state
            for t in range(CHUNK):
                if not len(again):
                    break
                state, out[t, again] = self.step(state, by_place[t, again])
                apart = path[t + 1, again] != state
                path[t + 1, again] = state
                again, state = again[apart], state[apart]
            for c in again.tolist():
                known[by_place[:, c].tobytes(), int(entry[c])] = out[:, c].copy(), path[:, c].copy()


def normalized(text: str) -> str:
    """NFC, then each character in lower case by itself (so that a sigma at a word's end is none of its own kind)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").replace("\ua7cb", "\u0264").replace("\ua7dc", "\u019b").lower()


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, and how many each has. Words are contractions, runs of letters, single numbers, or runs of others."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)]).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int16), np.zeros(len(texts), np.int64)
    points, at = code_points(data)
    n = len(points)
    kind = code_point_classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets if at is None else np.searchsorted(at, offsets)] = True
    first[n] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start |= first[:-1]
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        bound = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, np.array([ord(c) for c in "stmd"], np.uint32)) & ~bound[quote + 1]
        two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~bound[quote + 1] & ~bound[quote + 2]
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after[after < n]] = True
    end = np.append(start[1:], True)  # the last character of a word, or of white space
    inside = kind != SPACE
    if at is None:
        symbols = data.astype(np.int16) + END * end.astype(np.int16)
        per_text = inside
    else:
        width = np.diff(np.append(at, len(data)))
        symbols = data.astype(np.int16)
        symbols[(at + width - 1)[end]] += END
        inside = np.repeat(inside, width)
        per_text = inside
    counts = np.diff(np.concatenate([[0], np.cumsum(per_text)])[offsets])
    return symbols[inside], counts


@cache
def compiled_tokenizer(uri: str) -> tuple[Transducer, re.Pattern | None]:
    """Of a tokenizer file; kept by each Python worker. The pattern finds special strings, which are a token each."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        read = json.loads(f.read())
    special = [re.escape(t["content"]) for t in read.get("added_tokens", [])]
    model = read["model"]
    return Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"]), re.compile("|".join(special)) if special else None


def count_tokens(texts: list[str], uri: str) -> np.ndarray:
    """Tokens of each text."""
    transducer, special = compiled_tokenizer(uri)
    parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = special.split(text) if special is not None and special.search(text) else [text]
        extra[i] = len(found) - 1
        parts += map(normalized, found)
        owner += [i] * len(found)
    symbols, counts = symbols_of(parts)
    emitted = np.concatenate([[0], np.cumsum(transducer.emitted(symbols), dtype=np.int64)]) if len(symbols) else np.zeros(1, np.int64)
    ends = np.cumsum(counts)
    return extra + np.bincount(np.array(owner, np.int64), (emitted[ends] - emitted[ends - counts]).astype(np.float64), len(texts)).astype(np.int64)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is the empty text, with no tokens. Rows are kept as they are, repeated ones included; other columns are
    not looked at, whatever their names. No shuffle: each row is worked on where it is read.
    """

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch, "text"):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                n = count_tokens(texts, tokenizer)
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
