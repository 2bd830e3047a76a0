"""Benchmark decontamination by templates: re-parameterised questions are found as well as copies.

A text's words become template tokens. Numbers are <num>, units that follow a number <unit>, capitalised words inside a
sentence <name>; all else is lower-cased without punctuation at its ends. The value behind a placeholder is its slot.
Windows of WINDOW template tokens of all benchmark items are looked up for all windows of all texts; a window that is
mostly placeholders is looked up by its words and slot values instead, so that it meets copies only. Windows of a text that meet an item at nearby distances form an alignment, so that words
may be inserted, deleted or changed. Windows whose slots are not consistent with the others do not count: the same benchmark
value stands for the same value in the text, and different names for different names; different numbers may become equal. A
value that is unchanged in one place is only misspelt in another. An alignment whose windows cover enough of the item's
words marks the text; so does a run of VERBATIM words of the item, whatever share of it they are.

A capitalised word that opens a sentence may be a name or not. So texts are looked at twice: with these words as literals,
and with them as <name>, for items that have such words. An item of fewer than LEAST_WORDS words is found where it is a
whole line of a text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import find_words, mix, offsets_of, row_slices, span_hashes, text_buffer

WINDOW = 8
#: Template tokens of a window that must be words.
LEAST_LITERAL = 4
#: Share of an item's words that an alignment must cover, with consistent slots.
COVERED = 0.5
#: Words of an item, one after the other, that mark a text by themselves.
VERBATIM = 13
#: An item of fewer words is found as a whole line only; one of fewer words than a window is one window by itself.
LEAST_WORDS = 5
#: Benchmark text up to this size is held by each task; a larger benchmark is joined with texts by their windows' hashes.
SENT_BYTES = 16 << 20

UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kph hz khz mhz ghz w kw mw v kv a ma pa kpa psi bar j kj cal kcal k c f % percent meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres mile miles foot feet inch inches yard yards dollar dollars euro euros cent cents usd eur gbp $ € £ °c °f".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?%?")
_WITH_UNIT = re.compile(r"([$€£]?[+-]?\d+(?:[.,]\d+)*)([^\W\d_]{1,4}|%|°[cf])")
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’`*_~|"
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_U = np.uint64


@dataclass
class Templates:
    """Template tokens of texts: hashes, hashes of their slots, whether they are placeholders, and how many each text has;
    whether they are capitalised words that open a sentence, and whether they begin a line (or text)."""

    tokens: np.ndarray
    slots: np.ndarray
    is_slot: np.ndarray
    counts: np.ndarray
    opener: np.ndarray
    begins: np.ndarray

    def with_names(self) -> Templates:
        """With the words that open sentences as names."""
        return replace(self, tokens=np.where(self.opener, _NAME, self.tokens), is_slot=self.is_slot | self.opener)


_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}<>`*_~|"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\"'`*"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def canonical(column: pa.Array) -> Templates:
    """Vectorised over the words of texts; words with digits and words of capital letters outside ASCII are looked at singly."""
    data, offsets = text_buffer(column)
    starts, ends, counts = find_words(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, bool)
        return Templates(np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, counts, none, none)
    first = np.zeros(n + 1, bool)
    first[offsets_of(counts)] = True
    # a sentence begins with a text, after an ending mark, or on a new line
    line = offsets_of(data == 10)
    begins = first[:n].copy()
    begins[1:] |= line[starts[1:]] > line[ends[:-1]]
    opens = begins.copy()
    opens[1:] |= _STOP[data[ends[:-1] - 1]]
    low, high = starts.copy(), ends.copy()
    for _ in range(4):
        high -= (high - low > 1) & _TRIM[data[high - 1]]
        low += (high - low > 1) & _TRIM[data[low]]
    tokens = span_hashes(data, low, high, fold=True)
    capital = (data[low] >= 65) & (data[low] <= 90)
    wide = np.flatnonzero(data[low] >= 0xC3)
    digits = offsets_of(_DIGIT[data])
    numbers = digits[high] > digits[low]
    slots, is_slot = tokens.copy(), np.zeros(n, bool)
    whole = data.tobytes() if len(wide) or numbers.any() else b""
    lowered: dict[bytes, np.uint64 | None] = {}
    for i in wide.tolist():  # lower case beyond ASCII
        word = whole[low[i] : high[i]]
        if word not in lowered:
            text = word.decode()
            plain = text.lower().encode()
            lowered[word] = None if plain == word else span_hashes(np.frombuffer(plain, np.uint8), np.array([0]), np.array([len(plain)]), fold=True)[0]
        if lowered[word] is not None:
            tokens[i] = lowered[word]
            slots[i] = lowered[word]
            capital[i] = whole[low[i] : high[i]].decode()[0].isupper()
    names = capital & ~opens
    single = high - low < 2
    names &= ~single
    tokens[names] = _NAME
    is_slot |= names
    opener = capital & opens & ~single & ~numbers
    merged = np.zeros(n, bool)
    number_at = np.flatnonzero(numbers)
    for i in number_at.tolist():
        word = whole[low[i] : high[i]].decode().lower()
        if _NUMBER.fullmatch(word) or ((m := _WITH_UNIT.fullmatch(word)) and m[2] in UNITS):
            tokens[i], is_slot[i], merged[i] = _NUM, True, True
    after = np.flatnonzero(merged[:-1] & ~first[1:n]) + 1 if n > 1 else np.zeros(0, np.int64)
    for i in after.tolist():
        word = whole[low[i] : high[i]].decode().lower().strip(_EDGES)
        if word in UNITS:
            tokens[i], is_slot[i] = _UNIT, True
    return Templates(tokens, slots, is_slot, counts, opener & ~is_slot, begins)


def windows(t: Templates, size: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the windows of so many tokens that lie in one text and have enough words.

    plain: of all windows that lie in one text, and the hashes are of words and slot values.
    """
    n = len(t.tokens)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(t.counts)), t.counts)
    rolled = np.zeros(n - size + 1, np.uint64)
    values = t.slots if plain else t.tokens
    for k in range(size):
        rolled += mix(values[k : n - size + 1 + k] + _U(k + 1))
    literal = offsets_of(~t.is_slot)
    good = text[: n - size + 1] == text[size - 1 :]
    if not plain:
        good &= literal[size:] - literal[: n - size + 1] >= min(LEAST_LITERAL, size)
    place = np.flatnonzero(good)
    return place, mix(rolled[place] + _U(size))


class Items:
    """A benchmark's templates, and its windows by hash. named: the items with words that open sentences, as names."""

    def __init__(self, ids: list, texts: list[str], as_names: bool = False):
        self.ids = ids
        self.templates = canonical(pa.array(texts, pa.string()))
        opened = np.add.reduceat(np.append(self.templates.opener, False), offsets_of(self.templates.counts)[:-1]) * (self.templates.counts > 0) if len(ids) else np.zeros(0)
        self.named, self.places = None, np.flatnonzero(opened)
        if as_names:
            self.templates = self.templates.with_names()
        elif len(self.places):
            self.named = Items([ids[i] for i in self.places], [texts[i] for i in self.places], True)
        self.at = offsets_of(self.templates.counts)
        self.sizes = np.where(self.templates.counts < LEAST_WORDS, 0, np.minimum(self.templates.counts, WINDOW))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, LEAST_WORDS) if not as_names else ():
            place, hashes = windows(self.templates, size, True)
            item = np.searchsorted(self.at, place, side="right") - 1
            own = np.flatnonzero(self.templates.counts[item] == size)
            order = own[np.argsort(hashes[own], kind="stable")]
            if len(order):
                self.short[size] = hashes[order], item[order]
        self.windows: dict[tuple[int, bool], tuple] = {}
        self.total = np.zeros(len(ids), np.int64)
        self.by_words = np.zeros(len(ids), np.int64)
        held = np.zeros(len(self.templates.tokens) + 1, np.int64)
        for size in np.unique(self.sizes[self.sizes > 0]).tolist():
            known = np.zeros(0, np.int64)
            for plain in (False, True):
                place, hashes = windows(self.templates, size, plain)
                item = np.searchsorted(self.at, place, side="right") - 1
                own = (self.sizes[item] == size) & ~np.isin(place, known)
                place, hashes, item = place[own], hashes[own], item[own]
                order = np.argsort(hashes, kind="stable")
                self.windows[size, plain] = hashes[order], item[order], (place - self.at[item])[order]
                self.total += np.bincount(item, minlength=len(ids))
                if not plain:
                    known = place
                    self.by_words += np.bincount(item, minlength=len(ids))
                    for k in range(size):
                        held[place + k] = 1
        #: tokens of each item in windows that have enough words
        self.held = np.diff(offsets_of(held)[self.at])


def leaks(t: Templates, items: Items) -> list[tuple[int, int, int, int, bool, int]]:
    """(text, item, windows that meet, windows of the item, whether slots differ, first token) of the alignments that count,
    and of the short items that are lines; what is found with opening words as they are comes before what is found with
    them as names."""
    found = {v[:2]: v for v in [*_short_leaks(t, items), *_aligned(t, items)]}
    if items.named is not None:
        for text, item, *rest in _aligned(t.with_names(), items.named):
            found.setdefault((text, int(items.places[item])), (text, int(items.places[item]), *rest))
    return [found[k] for k in sorted(found)]


def _short_leaks(t: Templates, items: Items) -> list[tuple[int, int, int, int, bool, int]]:
    """The lines that are a short item, word by word."""
    out, at, n = [], offsets_of(t.counts), len(t.tokens)
    ends = np.append(t.begins, True)
    for size, (known, item) in items.short.items():
        place, hashes = windows(t, size, True)
        line = np.flatnonzero(t.begins[place] & ends[np.minimum(place + size, n)])
        low, high = np.searchsorted(known, hashes[line]), np.searchsorted(known, hashes[line], side="right")
        for i, a, b in zip(line[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            text = int(np.searchsorted(at, place[i], side="right") - 1)
            out += [(text, int(k), 1, 1, False, int(place[i] - at[text])) for k in item[a:b]]
    return sorted(set(out), reverse=True)


def _aligned(t: Templates, items: Items) -> list[tuple[int, int, int, int, bool, int]]:
    """The alignments that count."""
    at = offsets_of(t.counts)
    met = []
    for (size, plain), (known, item, place) in items.windows.items():
        if not len(known):
            continue
        here, hashes = windows(t, size, plain)
        if not len(here):
            continue
        low, high = np.searchsorted(known, hashes), np.searchsorted(known, hashes, side="right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        times = (high - low)[hit]
        entry = np.repeat(low[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        here = np.repeat(here[hit], times)
        text = np.searchsorted(at, here, side="right") - 1
        met.append(np.stack([text, item[entry], here - place[entry], place[entry], np.full(len(here), size), np.full(len(here), plain)], 1))
    if not met:
        return []
    met = np.unique(np.concatenate(met), axis=0)
    # shifts of a text and an item that follow each other closely are one alignment
    close = (met[1:, 0] == met[:-1, 0]) & (met[1:, 1] == met[:-1, 1]) & (met[1:, 2] - met[:-1, 2] <= WINDOW)
    best: dict[tuple[int, int], tuple] = {}
    for hits in np.split(met, np.flatnonzero(~close) + 1):
        text, item = hits[0, :2].tolist()
        n, start, stop = int(items.templates.counts[item]), items.at[item], (at[text], at[text + 1])
        verbatim = any(_longest_run(items, t, start, n, shift, stop) >= VERBATIM for shift in np.unique(hits[:, 2]).tolist())
        kept = _counting(items, t, start, item, n, hits)
        # what meets nearby by chance must not take away from a shift that counts by itself
        for shift in np.unique(hits[:, 2]).tolist() if not len(kept) else []:
            if len(kept := _counting(items, t, start, item, n, hits[hits[:, 2] == shift])):
                break
        if not verbatim and not len(kept):
            continue
        kept = kept if len(kept) else hits
        shifts, times = np.unique(kept[:, 2], return_counts=True)
        theirs, ours = _slots(items, t, start, kept)
        changed = bool((theirs != ours).any())
        count = len(np.unique(kept[:, 3]))
        shift = int(shifts[times.argmax()])
        found = (count, not changed, -shift)
        if (text, item) not in best or found > best[text, item][0]:
            best[text, item] = found, (text, item, count, int(items.total[item]), changed, int(shift - at[text]))
    return [v for _, v in sorted(best.values(), key=lambda x: x[1][:2])]


def _tokens(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of hits, place in the item, place in the batch) of the tokens of windows."""
    sizes = hits[:, 4]
    row = np.repeat(np.arange(len(hits)), sizes)
    there = hits[row, 3] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, there, there + hits[row, 2]


def _slots(items: Items, t: Templates, start: int, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The item's and the text's values of the slots in windows."""
    _, there, here = _tokens(hits)
    slot = items.templates.is_slot[there + start]
    return items.templates.slots[there[slot] + start], t.slots[here[slot]]


def _covered(hits: np.ndarray, n: int) -> int:
    """How many of an item's n tokens windows hold."""
    held = np.zeros(n, bool)
    held[_tokens(hits)[1]] = True
    return int(held.sum())


def _longest_run(items: Items, t: Templates, start: int, n: int, shift: int, stop: tuple[int, int]) -> int:
    """Most tokens, one after the other, that an item and a text at this shift have in common, slots included."""
    low, high = max(0, stop[0] - shift), min(n, stop[1] - shift)
    differ = np.flatnonzero(items.templates.slots[start + low : start + high] != t.slots[shift + low : shift + high])
    return int(np.diff(np.concatenate([[-1], differ, [high - low]])).max()) - 1


def _consistent(items: Items, t: Templates, start: int, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The windows of an alignment whose slots agree, those without any changed slot, and whether names disagree."""
    row, there, here = _tokens(hits)
    slot = items.templates.is_slot[there + start]
    row, there, here = row[slot], there[slot], here[slot]
    theirs, ours = items.templates.slots[there + start].tolist(), t.slots[here].tolist()
    name = (items.templates.tokens[there + start] == _NAME).tolist()
    places = dict(zip(zip(there.tolist(), here.tolist()), zip(theirs, ours, name)))
    stands, named = defaultdict(Counter), defaultdict(Counter)
    for _, (a, b, is_name) in sorted(places.items()):
        stands[a][b] += 1
        if is_name:
            named[b][a] += 1
    chosen = {a: a if a in c else c.most_common(1)[0][0] for a, c in stands.items()}
    owner = {b: b if b in c else c.most_common(1)[0][0] for b, c in named.items()}
    bad, names = np.zeros(len(row), bool), False
    for k, (a, b, is_name) in enumerate(zip(theirs, ours, name)):
        if chosen[a] != a and b != chosen[a] or is_name and owner[b] not in (a, b):
            bad[k], names = True, names or is_name
    changed = np.fromiter((a != b for a, b in zip(theirs, ours)), bool, len(theirs))
    return np.delete(hits, row[bad], 0), np.delete(hits, row[changed], 0), names


def _counting(items: Items, t: Templates, start: int, item: int, n: int, hits: np.ndarray) -> np.ndarray:
    """The windows of an alignment that count, or none if they are too few to mark the text."""
    kept, unchanged, names = _consistent(items, t, start, hits)
    if _covered(unchanged, n) >= COVERED * n:
        return kept
    by_words = kept[kept[:, 5] == 0]
    # where names disagree it may be another question: then the share is that of windows, which is less
    if not len(by_words) or names and len(np.unique(by_words[:, 3])) < COVERED * items.by_words[item]:
        return kept[:0]
    return kept if _covered(by_words, n) >= COVERED * items.held[item] else kept[:0]


SCHEMA = "doc_id long, item_id long, n_windows long, item_windows long, reparameterised boolean, first_word long"


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """A row for each text and benchmark item that it holds: doc_id, item_id, n_windows (of the best alignment that count),
    item_windows, reparameterised (whether slots have other values), first_word (the place of the item in the text).

    Null texts hold nothing; an item without words is not looked for. Repeated rows of documents give repeated rows; of items
    with the same id each is looked for. Other columns are not looked at. The benchmark's size is looked at first: up to
    SENT_BYTES it is sent to the tasks, and documents are read once without a shuffle; beyond, windows of both sides are
    joined by their hashes, and each text is compared with the items that it has a window in common with.
    """
    own = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    items = _items(benchmark, item_column, item_text_column)
    if not _is_small(items):
        keyed = own.withColumn("key", F.xxhash64("text"))
        found = _joined(keyed.select("key", "text").filter("text IS NOT NULL"), items)
        return keyed.select("doc_id", "key").join(found, "key").select(*(x.split()[0] for x in SCHEMA.split(", ")))
    sent = _sent(own.sparkSession, items)

    def run(batches):
        for batch in batches:
            for part in row_slices(batch, "text"):
                found = leaks(canonical(part.column("text")), sent.value)
                if found:
                    ids, item_ids = part.column("doc_id").to_pylist(), sent.value.ids
                    columns = [[ids[f[0]] for f in found], [item_ids[f[1]] for f in found], *([f[k] for f in found] for k in range(2, 6))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.bool_(), pa.int64()])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return own.mapInArrow(run, SCHEMA)


def _items(benchmark: DataFrame, item_column: str, item_text_column: str) -> DataFrame:
    return benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).cast("string").alias("item_text")).filter("item_text is not null")


def _is_small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("item_text")).alias("n")).first().n or 0) <= SENT_BYTES


def _sent(spark, items: DataFrame):
    rows = sorted(items.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.item_text))
    return spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.item_text for r in rows]))


def _window_rows(texts: DataFrame, sizes: list[int], of_items: bool) -> DataFrame:
    """key, hash: the different windows of each text (key, text): templates, words, and templates with opening words as
    names. Of an item, those of its own size only."""
    def run(batches):
        for batch in batches:
            for rows in row_slices(batch, "text"):
                t = canonical(rows.column("text"))
                at, keys = offsets_of(t.counts), rows.column("key").to_numpy()
                for size in sizes:
                    for kind, (made, plain) in enumerate(((t, False), (t, True), (t.with_names(), False))):
                        place, hashes = windows(made, size, plain)
                        text = np.searchsorted(at, place, side="right") - 1
                        if of_items:
                            fits = np.minimum(t.counts[text], WINDOW) == size
                            text, hashes = text[fits], hashes[fits]
                        pairs = np.unique(np.stack([keys[text].astype(np.int64), mix(hashes + _U(7 * size + kind)).astype(np.int64)], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "hash"])

    return texts.mapInArrow(run, "key long, hash long").distinct()


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """key and the columns of what is found, of different texts (key, text): texts and items meet by the hashes of windows;
    each pair that has met is compared as a whole."""
    texts, items = texts.dropDuplicates(["key"]), items.withColumn("key", F.xxhash64("item_id", "item_text"))
    words = F.size(F.regexp_extract_all("item_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    sizes = sorted(r.n for r in items.select(F.least(words, F.lit(WINDOW)).alias("n")).distinct().collect() if r.n)
    known = _window_rows(items.select("key", F.col("item_text").alias("text")), sizes, True).withColumnRenamed("key", "item")
    met = _window_rows(texts, sizes, False).join(known, "hash").select("key", "item").distinct()
    pairs = met.join(items.withColumnRenamed("key", "item").dropDuplicates(["item"]), "item").join(texts, "key").select("key", "text", "item_id", "item_text")

    def run(batches):
        for batch in batches:
            out = []
            for key, text, item_id, item_text in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "item_id", "item_text"))):
                out += [(key, item_id, *f[2:]) for f in leaks(canonical(pa.array([text], pa.string())), Items([item_id], [item_text]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.bool_(), pa.int64()])], names=["key", *(x.split()[0] for x in SCHEMA.split(", ")[1:])])

    return pairs.mapInArrow(run, SCHEMA.replace("doc_id", "key"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, whose text holds no benchmark item. A null text holds none."""
    items = _items(benchmark, item_column, item_text_column)
    if not _is_small(items):
        text = F.col(text_column).cast("string")
        found = _joined(documents.select(F.xxhash64(text).alias("key"), text.alias("text")).filter("text IS NOT NULL"), items).select("key").distinct()
        whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole")
        kept = documents.select(whole, F.xxhash64(text).alias("key")).join(found, "key", "left_anti")
        return kept.select(*(F.col("whole").getField(c).alias(c) for c in documents.columns))
    at = documents.columns.index(text_column)
    sent = _sent(documents.sparkSession, items)

    def run(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
            for piece in row_slices(named, "text"):
                clean = np.ones(piece.num_rows, bool)
                clean[[f[0] for f in leaks(canonical(piece.column("text")), sent.value)]] = False
                kept = piece.filter(pa.array(clean))
                if kept.num_rows:
                    yield kept.rename_columns(batch.schema.names)

    return documents.mapInArrow(run, documents.schema)
