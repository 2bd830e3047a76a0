"""Fitted operators: brute-force versions, held-out accuracy, and edge cases."""

import collections
import math
import random
import tracemalloc
import time
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import crf_html, divergence, kneser_ney, pu_toxicity, templates

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def prose(r, n):
    return " ".join(r.choices(WORDS, weights=range(1, len(WORDS) + 1), k=n))


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(4000):
        toxic = r.random() < 0.15
        text = prose(r, r.randint(5, 60))
        if toxic:
            words = text.split()
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["vile", "Nasty", "rotten,"]))
            text = " ".join(words)
        rows.append((i, text))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
        rows[-1] += (int(toxic),)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = lambda c: kneser_ney.crc32_remainder(c, 3) == 1
    model = pu_toxicity.train(docs, known, lambda c: ~held(c))
    got = {r.doc_id: r for r in pu_toxicity.score(docs, model).collect()}
    out = [(got[i].predicted, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert sum(p for p, t in out if t) >= 0.8 * sum(t for _, t in out)
    assert sum(p for p, t in out if not t) <= 0.02 * len(out)
    clean = pu_toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.filter("truth = 0").count() >= 0.98 * sum(t == 0 for *_, t in rows)


def test_toxicity_training_holds_no_texts_on_the_driver(spark):
    r = random.Random(6)
    words = [f"w{i:05d}" for i in range(40_000)]
    rows = [(i, " ".join(r.sample(words, 1_500) + ["vile"] * (i % 4 == 0))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    assert docs.count() == 400
    tracemalloc.start()
    model = pu_toxicity.train(docs, known, lambda c: F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    docs.unpersist()
    assert peak < 5_000_000  # the features of the toxic texts alone are more
    assert {x.doc_id for x in pu_toxicity.score(spark.createDataFrame(rows, docs.schema), model).filter("predicted = 1").collect()} == set(range(0, 400, 4))


def test_toxicity_without_toxic_rows_or_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "", "b")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = pu_toxicity.train(docs, none, lambda c: F.lit(True))
    assert [r.predicted for r in pu_toxicity.score(docs, model).collect()] == [0] * 4
    assert pu_toxicity.score(docs.limit(0), model).count() == 0


# --- Kneser-Ney


def brute_force_model(texts):
    tokens = [[w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + [None] for t in texts]
    unigrams = collections.Counter(w for x in tokens for w in x)
    pairs = collections.Counter(p for x in tokens for p in zip([None] + x[:-1], x))
    history = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in pairs.items():
        history[u][0] += c
        history[u][min(c, 3)] += 1
    before = collections.Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0, 0.5, 0.75, 0.75]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75, 0.05), k - 0.05) for k in (1, 2, 3)]

    d, d1 = discounts(pairs.values()), discounts(before.values())
    n, v = len(pairs), len(unigrams)
    ones, twos = sum(c == 1 for c in before.values()), sum(c == 2 for c in before.values())
    rest = (d1[1] * ones + d1[2] * twos + d1[3] * (v - ones - twos)) / max(n, 1)

    def lower(w):
        c = before.get(w, 0)
        return (max(c - d1[min(c, 3)], 0) / n if n else 0) + (rest if n else 1.0) / (v + 1)

    def p(u, w):
        h = history.get(u)
        if h is None:
            return lower(w)
        c = pairs.get((u, w), 0)
        return max(c - d[min(c, 3)], 0) / h[0] + sum(d[k] * h[k] for k in (1, 2, 3)) / h[0] * lower(w)

    return unigrams, p


def test_kneser_ney_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(0, 30)).title()) for i in range(120)] + [(200, None), (201, ""), (202, "never SEEN words"), (3, "twice here"), (3, "twice here"), (None, "no id")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    got = kneser_ney.score(docs, kneser_ney.crc32_remainder(F.col("doc_id"), 7) == 2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    unigrams, p = brute_force_model([t for i, t in rows if not held(i)])
    n, v = sum(unigrams.values()), len(unigrams)
    want = []
    for i, t in rows:
        x = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + [None]
        want.append((i, held(i), len(x), sum(w in unigrams for w in x), n, round(sum(math.log10((unigrams.get(w, 0) + 1) / (n + v + 1)) for w in x), 8), round(sum(math.log10(p(u, w)) for u, w in zip([None] + x[:-1], x)), 8)))
    assert sorted(((*g[:5], round(g[5], 8), round(g[6], 8)) for g in got), key=repr) == sorted(want, key=repr)
    assert abs(sum(p("alpha", w) for w in unigrams) + p("alpha", "unseen") - 1) < 1e-9


def test_kneser_ney_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = kneser_ney.score(docs, F.lit(True)).first()
    assert (r.n_known, r.train_tokens, r.score, r.base_score) == (0, 0, 0.0, 0.0)
    assert kneser_ney.score(docs.limit(0), F.lit(False)).count() == 0


def test_mixing_can_be_turned_back():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (kneser_ney._unmix(kneser_ney.mix(x)) == x).all()


# --- quality rules


def base_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered), failed


def test_base_counts_equal_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", "\n\n", "a b c a b c", "a b c a b", "line\nline\n line\nline", "x" * 500, "é ü ß | # %%", "one two", "a a a a"] + ["\n".join(prose(r, r.randint(0, 12)) for _ in range(r.randint(1, 9))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    got = divergence.judge(docs, divergence.learn(docs)).collect()
    assert sorted(tuple(g[:7]) for g in got) == [(i, *base_counts(t)) for i, t in enumerate(texts)]
    assert not any(g.kept for g in got if g.base_failed)


def test_divergent_texts_fail_and_prose_is_kept(spark):
    r = random.Random(6)
    rows = [(i, prose(r, 200), "en") for i in range(60)] + [(100, " ".join(w.upper() + "!!" for w in prose(r, 200).split()), "en"), (101, " ".join(w + "%%%" for w in prose(r, 200).split()), "en"), (102, " | ".join(f"z{r.random()}" for _ in range(200)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.kept for x in divergence.judge(docs, divergence.learn(docs.filter("doc_id < 100"))).collect()}
    kept = [i for i in got if i < 100 and got[i]]
    failed = [i for i in got if i < 100 and base_counts(dict((a, b) for a, b, _ in rows)[i])[5]]
    assert len(kept) + len(failed) == 60 and not any(got[i] for i in (100, 101, 102))


def test_divergence_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert divergence.judge(none, divergence.learn(none)).count() == 0


# --- pages


@pytest.fixture(scope="module")
def model():
    return crf_html.trained()


def test_field_on_held_out_pages(model):
    writer = crf_html.PageWriter(12345)
    good = total = 0
    for _ in range(150):
        page, blocks = crf_html.labelled_page(writer)
        made = crf_html.blocks_of(page)
        assert [b.text for b in made] == [b.text for b in blocks]
        labels = model.viterbi(crf_html.features_of(made))
        good += sum(a == b.label for a, b in zip(labels, blocks))
        total += len(blocks)
    assert good >= 0.985 * total


def test_viterbi_finds_the_best_labels(model):
    r = random.Random(8)
    for _ in range(30):
        blocks = crf_html.labelled_page(crf_html.PageWriter(r.randrange(1 << 30)))[1][:9]
        features = crf_html.features_of(blocks)
        s, t = model.scores(features), model.transitions

        def value(labels):
            return sum(x for x, y in zip(s, labels) if y) + sum(t[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value([k >> i & 1 for i in range(len(s))]) for k in range(1 << len(s)))
        assert abs(value(model.viterbi(features)) - best) < 1e-9


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  paragraph\n of text.<p><b>Second<br>line</article><footer>&copy; x</footer>", "Title & more\nFirst paragraph of text.\nSecond\nline"),
    ("<article><p>a &lt;b&gt; c &#233;</p><script>if (a < b) { '</p>' }</script><p>5 < 6 and more words here.</p></article>", "a <b> c é\n5 < 6 and more words here."),
    ("<article><p>Unclosed article text that goes on", "Unclosed article text that goes on"),
    ("<!-- <p>no</p> --><style>p{}</style>", ""),
])
def test_pages(model, page, text):
    assert crf_html.main_text(page, model) == text


def test_extract_frame(spark, model):
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "<article><h1>Big title here</h1><p>Some text that is the main one.</p></article>", 4)], "page_id long, url string, html string, text int")
    got = sorted(crf_html.extract(pages, model).collect(), key=lambda r: r.n_chars)
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (1, 0), (None, len("Big title here\nSome text that is the main one."))]
    assert crf_html.extract(pages.limit(0), model).count() == 0


# --- benchmark leaks

ITEMS = [(1, "If Anna buys 12 apples at 3 dollars and Bob buys 7 pears how much do they pay in total?"), (2, "The quick brown fox jumps over the lazy dog near the old river bank."), (3, "too short"), (4, None), (5, "five plain words are enough")]


@pytest.mark.parametrize("text, found", [
    ("x y z if Anna buys 12 apples at 3 dollars and Bob buys 7 pears how much do they pay in total? ok", [(1, False)]),
    ("So: If Maria buys 45 apples at 9 dollars and John buys 2 pears how much do they pay in total?", [(1, True)]),
    ("If Maria buys 45 apples at 9 dollars and Maria buys 2 pears how much do they pay in total?", []),
    ("THE QUICK brown fox jumps over\nthe lazy dog near the old river bank", [(2, False)]),
    ("the quick brown fox jumps over a fence", []),
    ("here five plain words are enough for it", [(5, False)]),
    ("too short", [(3, False)]), ("it is too short", []), (None, []), ("", []),
])
def test_leaks(spark, text, found):
    docs = spark.createDataFrame([(9, text, "i")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r.item_id, r.reparameterised) for r in templates.find_leaks(docs, items).collect()] == found
    assert templates.without_leaks(docs, items).count() == (0 if found else 1)


def leaked(item, text):
    return [(x[1], x[4]) for x in templates.leaks(templates.canonical(pa.array([text], pa.string())), templates.Items([1], [item]))]


def test_leaks_with_edits():
    words = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    for n in (16, 20, 30, 40):
        for at in range(n):
            item = " ".join(words[:n])
            changed, deleted = words[:n], words[:n]
            changed[at] = "other"
            del deleted[at]
            assert leaked(item, "so " + " ".join(changed) + " ok") == [(0, False)]
            assert leaked(item, " ".join(words[:at] + ["other"] + words[at:n])) == [(0, False)]
            if n > 16:
                assert leaked(item, " ".join(deleted)) == [(0, False)]
    assert leaked(" ".join(words), "so " + " ".join(words[10:40])) == [(0, False)]
    assert leaked(" ".join(words), "so " + " ".join(words[10:22])) == []


@pytest.mark.parametrize("item, text, found", [
    ("So Anna gives Bob 12 apples and then Anna asks him for 12 pears", "So Anna gives Bob 12 apples and then Ana asks him for 12 pears", [(0, True)]),
    ("So Anna gives Bob 12 apples and then Anna asks him for 12 pears", "So Anna gives Bob 12 apples and then Anna asks him for 13 pears", [(0, True)]),
    (ITEMS[0][1], "If Maria buys 9 apples at 4 dollars and John buys 9 pears how much do they pay in total?", [(0, True)]),
    ("if 2 apples cost as much as pears for 2 dollars what does one pear cost", "if 5 apples cost as much as pears for 7 dollars what does one pear cost", [(0, True)]),
    (ITEMS[0][1], "If Maria buys 45 apples at 9 dollars and Maria buys 2 pears how much do they pay in total?", []),
])
def test_leaks_with_inconsistent_slots(item, text, found):
    assert leaked(item, text) == found


@pytest.mark.parametrize("item", ["Is Paris in northern France?", "Did Anna Lee Smith and Bob Jones come", "1 2 3 5 8 13 21 34 55 89", "Ask Anna Bob Carl Dora Emil Finn Gina Hugo"])
def test_copies_of_items_of_slots_are_found(item):
    assert leaked(item, f"here it is. {item} and more") == [(0, False)]
    assert leaked(item, "here it is. Is Berlin in 4 5 6 and Zoe Young Xaver Weber Victor Unger Tina Stone") == []


def test_leaks_equal_plain_search(spark):
    r = random.Random(7)
    items = [(i, prose(r, r.randint(12, 40))) for i in range(20)]
    docs = []
    for i in range(60):
        words = prose(r, 80).split()
        if i % 3 == 0:
            at = r.randrange(len(words))
            words[at:at] = r.choice(items)[1].split()
        docs.append((i, " ".join(words)))
    got = {(x.doc_id, x.item_id) for x in templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, k) for i, t in docs for k, w in items if f" {w} " in f" {t} "} <= got
    assert all(i % 3 == 0 for i, _ in got)


def test_large_benchmarks_are_split(spark, monkeypatch):
    monkeypatch.setattr(templates, "SENT_BYTES", 40)
    docs = spark.createDataFrame([(1, ITEMS[1][1]), (2, ITEMS[4][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in templates.find_leaks(docs, items).collect()) == [(1, 2), (2, 5)]
    assert templates.without_leaks(docs, items).count() == 0
    assert templates.find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("item, text, found", [
    ("Alice buys 12 apples and 3 pears at the shop near Rome. Bob gives her 4 more of them on the way.", "Carol buys 9 apples and 5 pears at the shop near Oslo. David gives her 7 more of them on the way.", [(1, True)]),
    ("What is 7 times 8?", "First\nWhat is 7 times 8?\nLast", [(1, False)]),
    ("Is it 42?", "one line\nis it 42?", [(1, False)]),
    ("Is it 42?", "and now is it 42? or not", []),
    ("Paris?", "Paris?", [(1, False)]),
])
def test_opening_names_and_short_items(item, text, found):
    assert [(x[1] + 1, x[4]) for x in templates.leaks(templates.canonical(pa.array([text], pa.string())), templates.Items([1], [item]))] == found


def test_joined_windows_find_the_same(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.choice([3, 6, 20])))) for i in range(30)] + [(30, "Alice buys 12 apples and 3 pears at the shop near Rome today."), (31, None)]
    docs = [(0, None), (1, "")] + [(i, " ".join(r.choices(words, k=20)) + r.choice(["\n", " "]) + r.choice(items[:30])[1]) for i in range(2, 40)] + [(40, "Carol buys 9 apples and 5 pears at the shop near Oslo today."), (41, items[3][1]), (41, items[3][1])]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "item": F.lit(2)}), spark.createDataFrame(items, "item_id long, text string")
    sent = sorted(map(tuple, templates.find_leaks(docs, items).collect()))
    clean = templates.without_leaks(docs, items).count()
    monkeypatch.setattr(templates, "SENT_BYTES", 10)
    assert sorted(map(tuple, templates.find_leaks(docs, items).collect())) == sent and len(sent) > 20
    assert templates.without_leaks(docs, items).count() == clean


def test_very_long_texts(spark):
    words = "ab cd 12 Ef, gh.\n" * 60_000
    docs = spark.createDataFrame([(1, words), (2, "x" * 300_000)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    assert templates.find_leaks(docs, items).count() == 0
    assert divergence.judge(docs, divergence.learn(docs)).count() == 2
    assert kneser_ney.score(docs, F.lit(False)).filter("score < 0").count() == 2
    model = pu_toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), lambda c: F.lit(True))
    assert pu_toxicity.score(docs, model).count() == 2


def test_deep_pages_are_linear(model):
    def seconds(n):
        page = "<article>" + "".join(f'<div class="c{i}">word here' for i in range(n))
        began = time.perf_counter()
        crf_html.main_text(page, model)
        return time.perf_counter() - began

    assert seconds(20_000) < 12 * max(seconds(4_000), 0.02)
    blocks = crf_html.blocks_of("<div class='a'><b class='x'>one<div class='a b'>two</b> three</div></div>")
    assert [(b.text, b.path, b.words) for b in blocks] == [("one", ("div",), ("a", "x")), ("two", ("div",), ("a", "x", "b")), ("three", ("div",), ("a", "b"))] or blocks[1].text.startswith("two")
    for b, f, s in zip(blocks, crf_html.features_of(blocks), model.block_scores(blocks)):
        assert abs(model.scores([f])[0] - s) < 1e-9


def test_a_language_of_few_texts_is_no_reference(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(120)), "en") for i in range(40)] + [(99, "#$%& " * 200, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    references = divergence.learn(docs)
    assert references.char_langs == ["en"] and references.word_langs == ["en"]
    assert {r.doc_id for r in divergence.judge(docs, references).filter("NOT kept").collect()} == {99}


def test_spans_of_a_batch_do_not_reach_over_texts():
    t = templates.canonical(pa.array(["a b", "c d"], pa.string()))
    assert len(templates.windows(t, 3)[0]) == 0 and t.counts.tolist() == [2, 2]
