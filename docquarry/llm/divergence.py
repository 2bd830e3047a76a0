"""Quality rules: base counts, and the divergence of a text from references of its language.

Two histograms describe a text: its characters by class, and its words by the common words of a language (the rest is
one bin). References are the means over all texts of a language that are long enough, of the normalised histograms, so
that each text counts alike. A text fails if its Jensen-Shannon distance (base 2, so 0 to 1) from the nearest reference
exceeds a limit; each histogram has a least length below which it is not looked at.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import IS_SPACE, find_words, mix, offsets_of, row_slices, span_hashes, text_buffer
from .pieces import code_points

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Classes of characters: lower-case letters, capitals, other letters and marks, digits, white space, then punctuation by kind.
CLASSES = 10
#: A word is common in a language if it is at least this share of its words.
COMMON_SHARE = 0.002
MOST_COMMON = 400
#: Words of a language that a task counts before it hands on the frequent ones.
COUNTED = 200_000
LEAST_CHARS_COMPARED, LEAST_WORDS_COMPARED = 200, 50
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.47
#: Texts that a language must have to be a reference.
LEAST_REFERENCE = 30
_U = np.uint64


@cache
def character_classes() -> np.ndarray:
    out = np.full(0x110000, 9, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind == "Ll":
            out[i] = 0
        elif kind in ("Lu", "Lt"):
            out[i] = 1
        elif kind[0] in "LM":
            out[i] = 2
        elif kind[0] == "N":
            out[i] = 3
        elif kind[0] == "Z" or 9 <= i <= 13:
            out[i] = 4
        elif chr(i) in ".,;:":
            out[i] = 5
        elif chr(i) in "!?":
            out[i] = 6
        elif kind[0] == "P" and chr(i) not in "#*%&":
            out[i] = 7
        elif kind[0] in "SP":
            out[i] = 8
    return out


@dataclass
class Spans:
    """A batch of texts and its words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Spans:
        data, offsets = text_buffer(column)
        return cls(data, offsets, *find_words(data, offsets))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(offsets_of(flags)[offsets])


def base_counts(s: Spans) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    lead = (s.data & 0xC0) != 0x80
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    n = len(s.counts)
    return {
        "n_words": s.counts,
        "word_chars": _per_text(lead & ~IS_SPACE[s.data], s.offsets),
        "n_symbols": _per_text(is_symbol[s.data], s.offsets),
        "n_dup_lines": _repeated_lines(s),
        "n_repeat_words": _repeated_words(span_hashes(s.data, s.starts, s.ends), s.counts) if n else s.counts,
    }


def base_failed(s: Spans, repeated: np.ndarray | None = None) -> np.ndarray:
    """Whether texts have too few words, or too many that are in repeated windows."""
    if repeated is None:
        repeated = _repeated_words(span_hashes(s.data, s.starts, s.ends), s.counts) if len(s.counts) else s.counts
    return (s.counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * s.counts)


def _repeated_lines(s: Spans) -> np.ndarray:
    n = len(s.counts)
    cut = s.data == 10
    begin = np.zeros(len(s.data) + 1, bool)
    begin[1:] = cut
    begin[s.offsets] = True
    starts = np.flatnonzero(begin[:-1])
    ends = np.append(starts[1:], len(s.data))
    ends = ends - (cut[ends - 1] if len(ends) else 0)
    keep = (offsets_of(~IS_SPACE[s.data])[ends] - offsets_of(~IS_SPACE[s.data])[starts]) > 0
    starts, ends = starts[keep], ends[keep]
    text = np.searchsorted(s.offsets, starts, side="right") - 1
    lines = np.bincount(text, minlength=n)
    keys = np.unique(mix(span_hashes(s.data, starts, ends) + mix(text.astype(np.uint64) + _U(1))), return_index=True)[1]
    return lines - np.bincount(text[keys], minlength=n)


def _repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words in windows of three that are found twice or more in a text, the first one included."""
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    covered = np.zeros(len(words) + 2, bool)
    if len(words) > 2:
        whole = np.flatnonzero(text[:-2] == text[2:])
        windows = mix(mix(words[whole] + _U(1)) + mix(words[whole + 1] + _U(2)) * _U(3) + mix(words[whole + 2] + _U(3)) * _U(5) + mix(text[whole].astype(np.uint64) + _U(4)))
        order = np.argsort(windows)
        ordered = windows[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for k in range(3):
            covered[whole[twice] + k] = True
    return np.bincount(text[covered[: len(words)]], minlength=n)


def char_histograms(s: Spans) -> np.ndarray:
    points, at = code_points(s.data)
    n = len(s.counts)
    text = np.repeat(np.arange(n), np.diff(s.offsets if at is None else np.searchsorted(at, s.offsets)))
    return np.bincount(text * CLASSES + character_classes()[points], minlength=n * CLASSES).reshape(n, CLASSES)


def word_histograms(s: Spans, common: np.ndarray) -> np.ndarray:
    """Counts of the common words (sorted hashes), and of all others in a last bin."""
    n, bins = len(s.counts), len(common) + 1
    hashes = span_hashes(s.data, s.starts, s.ends, fold=True)
    place = np.full(len(hashes), bins - 1)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        place = np.where(common[at] == hashes, at, bins - 1)
    return np.bincount(np.repeat(np.arange(n), s.counts) * bins + place, minlength=n * bins).reshape(n, bins)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def distances(p: np.ndarray, references: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Jensen-Shannon distance of each row to its own reference (its place, or -1 if it has none), or to the nearest one; 0
    if there are no references."""
    def divergence(a, m):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    if not len(references):
        return np.zeros(len(p))
    own = np.full(len(p), -1) if own is None else own
    nearest = np.full(len(p), np.inf)
    for k, r in enumerate(references):
        rows = np.flatnonzero((own == k) | (own < 0))
        m = (p[rows] + r) / 2
        nearest[rows] = np.minimum(nearest[rows], divergence(p[rows], m) / 2 + divergence(r[None, :], m) / 2)
    return np.sqrt(np.clip(nearest, 0, 1))


@dataclass
class References:
    """Common words, and of each language that has a reference its histograms; langs names their rows."""

    common: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    char_langs: list[str]
    word_langs: list[str]


def learn(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> References:
    """References of each language: means over all its texts that are long enough and pass the base rules; a null language
    is one of its own. A language of fewer than LEAST_REFERENCE such texts has none, as a few texts would be their own.
    Null and empty texts add nothing; repeated rows count as often as they are there.

    Two passes. Each task counts some words of a language, hands on those that are half of COMMON_SHARE of them, and
    begins anew. What it does not hand on of a word is less than half the share of all words; so each common word's
    counts add up to the other half at least, and there are at most 2 / COMMON_SHARE such candidates in a language. The
    second pass counts these exactly and makes the means of the histograms.
    """
    own = documents.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.col(text_column).cast("string").alias("text"))

    def by_language(rows):
        langs = rows.column("lang").to_numpy(zero_copy_only=False)
        return [(name, np.flatnonzero(langs == name)) for name in np.unique(langs)]

    def frequent(batches):
        held: dict[str, list] = {}

        def handed_on(lang):
            values, inverse = np.unique(np.concatenate(held[lang]), return_inverse=True)
            counts = np.bincount(inverse)
            large = np.flatnonzero(counts >= COMMON_SHARE / 2 * len(inverse))
            words = [None, *values[large].astype(np.int64).tolist()]
            held[lang] = []
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.int64()), pa.array([len(inverse), *counts[large].tolist()], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for rows in row_slices(batch, "text"):
                for lang, at in by_language(rows):
                    s = Spans.of(rows.column("text").take(pa.array(at)))
                    held.setdefault(lang, []).append(span_hashes(s.data, s.starts, s.ends, fold=True))
                    if sum(map(len, held[lang])) >= COUNTED:
                        yield handed_on(lang)
        for lang in held:
            if any(map(len, held[lang])):
                yield handed_on(lang)

    made = own.mapInArrow(frequent, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = made.filter("word is null").select("lang", F.col("n").alias("total"))
    candidates = made.filter("word is not null").join(totals, "lang").filter(F.col("n") >= COMMON_SHARE / 2 * F.col("total")).select("word").distinct().collect()
    candidates = np.sort(np.array([r.word for r in candidates], np.int64).astype(np.uint64))

    def sums(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for rows in row_slices(batch, "text"):
                for lang, at in by_language(rows):
                    s = Spans.of(rows.column("text").take(pa.array(at)))
                    words, chars = word_histograms(s, candidates), char_histograms(s)
                    good = ~base_failed(s)
                    long_words, long_chars = good & (s.counts >= LEAST_WORDS_COMPARED), good & (chars.sum(1) >= LEAST_CHARS_COMPARED)
                    made = [words.sum(0).astype(float), _shares(words[long_words]).sum(0), np.array([long_words.sum()], float), _shares(chars[long_chars]).sum(0), np.array([long_chars.sum()], float)]
                    held[lang] = [a + b for a, b in zip(held[lang], made)] if lang in held else made
        for lang, made in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.concatenate(made).tolist()], pa.list_(pa.float64()))], names=["lang", "sums"])

    width = len(candidates) + 1
    # the languages' rows of each task are summed by element: one array of a fixed width for each language comes back
    total = own.mapInArrow(sums, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    # a row for each language with enough texts; the others add no reference and do not come back
    enough = F.greatest(F.element_at("xs", -1)["x"], F.element_at("xs", 2 * width + 1)["x"]) >= LEAST_REFERENCE
    rows = total.filter(enough).orderBy("lang").collect()
    languages = [np.array([x.x for x in r.xs]) for r in rows]
    common = np.zeros(width - 1, bool)
    for x in languages:
        share = x[: width - 1] / max(1.0, x[:width].sum())
        top = np.argsort(-share, kind="stable")[:MOST_COMMON]
        common[top[share[top] >= COMMON_SHARE]] = True
    chars, words, char_langs, word_langs = [], [], [], []
    for lang, x in zip((r.lang for r in rows), languages):
        w, n, c, m = x[width : 2 * width], x[2 * width], x[2 * width + 1 : 2 * width + 1 + CLASSES], x[-1]
        if n >= LEAST_REFERENCE:
            word_langs.append(lang)
            words.append(np.append(w[:-1][common], w[:-1][~common].sum() + w[-1]) / n)
        if m >= LEAST_REFERENCE:
            char_langs.append(lang)
            chars.append(c / m)
    return References(candidates[common], np.array(chars), np.array(words), char_langs, word_langs)


def judge(documents: DataFrame, references: References, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A text is compared with its own language; with the nearest of all references if that has none, or if there is no such
    column. A null text has no words and fails. Distances are null where the text is too short for them. Rows are kept as they
    are, repeated ones included. No shuffle; references are of a bounded size.
    """
    sent = documents.sparkSession.sparkContext.broadcast(references)
    kinds = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}

    def run(batches):
        r = sent.value
        for batch in batches:
            for rows in row_slices(batch, "text"):
                s = Spans.of(rows.column("text"))
                base, chars = base_counts(s), char_histograms(s)
                langs = rows.column("lang").to_pylist()
                own_chars, own_words = (np.array([at.get(x, -1) for x in langs], np.int64) for at in ({x: k for k, x in enumerate(names)} for names in (r.char_langs, r.word_langs)))
                by_char, by_word = distances(_shares(chars), r.chars, own_chars), distances(_shares(word_histograms(s, r.common)), r.words, own_words)
                compared_chars, compared_words = chars.sum(1) >= LEAST_CHARS_COMPARED, s.counts >= LEAST_WORDS_COMPARED
                failed = base_failed(s, base["n_repeat_words"])
                kept = ~failed & ~(compared_chars & (by_char > CHAR_LIMIT)) & ~(compared_words & (by_word > WORD_LIMIT))
                columns = [rows.column("doc_id"), *(pa.array(base[k].astype(np.int64), t) for k, t in kinds.items()), pa.array(failed), pa.array(kept), pa.array(by_char, mask=~compared_chars), pa.array(by_word, mask=~compared_words)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *kinds, "base_failed", "kept", "char_distance", "word_distance"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in kinds) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("")) if lang_column in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, schema)
