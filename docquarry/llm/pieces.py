"""The split of text that byte-level BPE vocabularies share, vectorised over code points."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

from .arrowtext import offsets_of, ranges, span_hashes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@cache
def code_point_classes() -> np.ndarray:
    """Of each code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            low, high = ord(m[0][0]), ord(m[0][-1])
            out[low : high + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and the byte at which each begins (None: byte i is code point i)."""
    lead = (data & 0xC0) != 0x80
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), None
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.flatnonzero(lead)


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of '(?:[sdmt]|ll|ve|re)| ?letters| ?numbers| ?others|spaces not before a non-space|spaces.

    Returns byte starts, byte ends, and matches in each text. Matches cover a text, so that each ends where
    the next begins. The text between white space is cut where the class changes; a space goes with what
    follows; of longer white space, the last character is cut off if something follows.
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    kind = code_point_classes()[points]
    first = np.zeros(n + 1, bool)  # where a text begins, and the end
    begins = offsets if at is None else np.searchsorted(at, offsets)
    first[begins] = True
    first[n] = True
    space = kind == SPACE
    blank = points == 0x20
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= ~blank[:-1] | space[1:]  # what follows a space begins with that space
    nonspace_next = np.zeros(n, bool)
    nonspace_next[:-1] = ~space[1:] & ~first[1:-1]
    start |= space & nonspace_next  # the last of a run that something follows; alone, it began the run
    start |= first[:-1]
    # contractions begin at an apostrophe that begins a match
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
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, begins))
    if at is not None:
        starts = at[starts]
    ends = np.append(starts[1:], len(data))
    return starts, ends, counts


class PieceCoder:
    """Token ids of texts from the ids of their distinct pieces.

    Two generations of known pieces are kept, so that memory is bounded and frequent pieces stay.

    encode(list of bytes) -> list of little-endian uint32 ids as bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 500_000):
        self.encode, self.most, self.known, self.old = encode, most, {}, {}

    def forget(self) -> None:
        """Gives up the older generation, and the younger one where it is large."""
        self.old = {}
        if len(self.known) > self.most // 4:
            self.known = {}

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        starts, ends, counts = split_pieces(data, offsets)
        flat, sizes = self.piece_ids(data, starts, ends)
        at = offsets_of(sizes)[offsets_of(counts)]
        return flat, np.diff(at)

    def piece_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of given pieces, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        whole = data.tobytes()
        keys = [whole[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        missing = [k for k in keys if k not in known]
        known.update((k, old[k]) for k in missing if k in old)
        missing = [k for k in missing if k not in known]
        known.update(zip(missing, self.encode(missing)))
        made = [known[k] for k in keys]
        flat = np.frombuffer(b"".join(made), np.uint32)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        at = offsets_of(sizes)[:-1]
        sizes_all = sizes[inverse]
        return flat[ranges(at[inverse], sizes_all)], sizes_all
