"""Near-copy operators against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm import line_dedup, linking, ngram_join
from docquarry.llm.scratch import Scratch

WORDS = [f"w{i}" for i in range(400)]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return words


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    rows, k = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "two words"), (6, "two Words"), (7, "a b c")], 8
    for _ in range(12):
        base = r.choices(WORDS, k=r.choice([5, 20, 60, 150]))
        for n in [0] + r.choices(range(8), k=r.choice([1, 3, 40])):
            rows.append((k, " ".join(edited(r, base, n))))
            k += 1
    return rows + [(9, "repeated row twice over here"), (9, "repeated row twice over here"), (None, "no id at all here"), (None, "no id at all here")]


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(n)))) if len(words) >= n else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_components_equal_brute_force(spark, corpus, n, percent):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node", "2 AS component_id")
    got = [tuple(r) for r in ngram_join.link_documents(docs, n, percent, Scratch(spark, "t")).collect()]
    sets = [shingle_set(t, n) for _, t in corpus]
    parent = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(parent, i)] = find(parent, j)
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(corpus):
        if doc_id is not None:
            groups[find(parent, i)].append(doc_id)
    want = [(doc_id, len(sets[i]), min(groups[find(parent, i)], default=None)) for i, (doc_id, _) in enumerate(corpus)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_of_each_keeps_clean_rows(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (9, "something else entirely different here now", "z"), (1, None, "n"), (2, "", "e"), (None, "no id", "q"), (None, "no id", "q"), (7, "same id", "1"), (7, "same id other", "2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    docs = docs.withColumns({"key": docs._id, "whole": docs._id, "nth": docs.doc_id, "node": docs.doc_id})
    got = ngram_join.one_of_each(docs, 5, 80, Scratch(spark, "t"))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 3, 7, 7, 9]


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_documents(none, 3, 90, Scratch(spark, "t")).count() == 0
    assert line_dedup.dedup_lines(none, Scratch(spark, "t")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.c for r in linking.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert linking.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def char_set(line):
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def test_lines_equal_brute_force(spark):
    r = random.Random(9)
    bases = [" ".join(r.choices(WORDS, k=n)) for n in (6, 8, 12, 20, 30, 45, 60, 90)] + ["x" * 40 + "y" * 200, "é" * 60 + " ü" * 30]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            words = r.choice(bases).split(" ")
            if r.random() < 0.6:
                words[r.randrange(len(words))] = r.choice(WORDS)
            line = " ".join(words)
            lines.append(line.upper() if r.random() < 0.2 else line + " " if r.random() < 0.2 else line)
        rows.append((i, "\n".join(lines + ["short line", ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.line): (x.kept_doc_id, x.kept_line) for x in line_dedup.duplicate_lines(docs, Scratch(spark, "t")).collect()}
    places = [((d, k), line.lower().strip(" ")) for d, t in rows for k, line in enumerate(t.split("\n")) if len(line.strip(" ")) >= line_dedup.LEAST_CHARS]
    parent = list(range(len(places)))
    sets = [char_set(line) for _, line in places]
    for i in range(len(places)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= line_dedup.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    want = {p: places[find(parent, i)][0] for i, (p, _) in enumerate(places) if find(parent, i) != i}
    missed = [p for p in want if p not in got]
    assert len(missed) <= 0.02 * len(want) and set(got) <= set(want)


def test_short_lines_equal_brute_force(spark):
    r = random.Random(3)
    bases = ["a", "-", "no", "page 12", "all rights reserved.", "read more here", "これは短い文です。", "subscribe to our news", "-" * 30, "table of contents and notes"]
    lines = []
    for _ in range(300):
        line = r.choice(bases)
        at = r.choice([0, len(line)])
        lines.append(r.choice([line, line.upper(), line + " ", line[:at] + r.choice("xyz!") + line[at:], line * 2, line[1:], "\t"]))
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(100)]
    got = {(x.doc_id, x.line): (x.kept_doc_id, x.kept_line) for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    places = [(divmod(i, 3), line.lower().strip(" ")) for i, line in enumerate(lines) if line.strip()]
    sets, parent = [char_set(line) for _, line in places], list(range(len(places)))
    for i in range(len(places)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= line_dedup.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert got == {p: places[find(parent, i)][0] for i, (p, _) in enumerate(places) if find(parent, i) != i}


def test_scattered_edits_of_long_lines_are_found(spark):
    r, rows, pairs = random.Random(11), [], 0
    for size in (200, 400, 1000):
        for edit in ("change", "delete"):
            for _ in range(60):
                one = "".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=size)).strip()
                other, last = one, one
                while True:
                    at = r.randrange(len(other))
                    other = other[:at] + (r.choice("0123456789") if edit == "change" else "") + other[at + 1 :]
                    x, y = char_set(one), char_set(other.strip())
                    if len(x & y) < 0.8 * len(x | y):
                        break
                    last = other
                rows += [(2 * pairs, one), (2 * pairs + 1, last)]
                pairs += 1
    got = {(x.kept_doc_id, x.doc_id) for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(pairs)}
    assert got <= want and len(want - got) <= 0.01 * pairs


def letters(r, n):
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)).strip()


def test_lines_with_a_common_passage_make_no_pairs(spark, monkeypatch):
    r = random.Random(5)
    passage = letters(r, 200)
    rows = [(i, f"{letters(r, 300)} {passage}") for i in range(60)]
    compared = []

    def counted(postings, verify, *args, **kwargs):
        def run(pairs):
            compared.append(pairs.count())
            return verify(pairs)

        return linking.link_groups(postings, run, *args, **kwargs)

    monkeypatch.setattr(line_dedup, "link_groups", counted)
    assert line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).count() == 0
    assert sum(compared) == 0


def test_open_groups_make_links_only(spark, monkeypatch):
    r = random.Random(6)
    base, lines = r.choices(WORDS, k=90), []
    for _ in range(80):
        lines.append(" ".join(edited(r, base, r.randrange(14))))
    lines += ["ab" * 400, "ab" * 400 + "c", letters(r, 150) * 8]
    lines.append(lines[-1] + "!")
    given = []

    def counted(*args, rest, **kwargs):
        def run(left):
            made = rest(left)
            given.extend(tuple(x) for x in made.distinct().collect())
            return made

        return linking.link_groups(*args, rest=run, **kwargs)

    monkeypatch.setattr(line_dedup, "link_groups", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.kept_doc_id for x in line_dedup.duplicate_lines(docs, Scratch(spark, "t")).collect()}
    sets, parent = [char_set(line) for line in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= line_dedup.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(parent, i) for i in range(len(lines)) if find(parent, i) != i}
    of_node = {r.node: r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(lower(text)) AS node").collect()}
    for a, b in given:
        x, y = sets[of_node[a]], sets[of_node[b]]
        assert len(x & y) >= line_dedup.SIMILARITY * len(x | y)


def test_dedup_keeps_first_lines_and_every_row(spark):
    long = "this is a line that is long enough to be looked at"
    rows = [(2, f"{long}\nonly here, and it is long enough too", "b"), (1, f"head\n{long}", "a"), (3, None, "c"), (4, f"{long}!", "d"), (5, "head\nhead", "e"), (6, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {r.doc_id: (r.text, r.removed) for r in line_dedup.dedup_lines(docs.withColumns({"key": docs.removed, "row": docs.removed, "gone": docs.doc_id, "whole": docs.doc_id, "was": docs.text, "line": docs.text}), Scratch(spark, "t")).collect()}
    assert got == {1: (f"head\n{long}", "a"), 2: ("only here, and it is long enough too", "b"), 3: (None, "c"), 4: ("", "d"), 5: ("", "e"), 6: ("", "f")}


def test_line_dedup_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough to be looked at")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs, Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pairs_of_a_group_are_looked_at_by_bits_first(spark, monkeypatch):
    r = random.Random(8)
    passage = letters(r, 120)
    lines = [f"{letters(r, 300)} {passage}" for _ in range(60)]
    lines += [lines[0][:200] + "7" + lines[0][201:], lines[1] + "!"]
    seen, left = [], []

    def linked(postings, *args, details, alike, narrow, **kwargs):
        seen.append(dict(details.dtypes))

        def narrowed(pairs):
            left.append(pairs.count())
            return narrow(pairs)

        return linking.link_groups(postings, *args, details=details, alike=alike, narrow=narrowed, **kwargs)

    monkeypatch.setattr(line_dedup, "link_groups", linked)
    scratch = Scratch(spark, "t")
    got = {(x.kept_doc_id, x.doc_id) for x in line_dedup.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), scratch).collect()}
    assert got == {(0, 60), (1, 61)}
    assert seen == [{"node": "bigint", "low": "bigint", "high": "bigint"}]  # not the sketches
    assert sum(left) <= 10  # of the 1891 pairs of the passage's groups
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    kept = {x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    assert all(name == "places" or name.startswith("lines-comp-") for name in kept)


def test_bits_lose_no_similar_lines(spark):
    r, rows = random.Random(9), []
    for n in (100, 300, 1000):
        for k in range(100):
            one = r.sample(range(-(2**31), 2**31), n)
            other = one[: -(-8 * n // 10)] if k % 2 else one[: -(-8 * n // 9)] + r.sample(range(-(2**31), 2**31), n - -(-8 * n // 9))
            rows.append((sorted(one)[: line_dedup.SKETCH], sorted(other)[: line_dedup.SKETCH]))
    df = spark.createDataFrame(rows, "x array<int>, y array<int>")
    df = df.select(*(c.alias(f"{c2}_{x}") for x in "xy" for c, c2 in zip(line_dedup._marks(F.col(x)), ("low", "high"))))
    assert df.filter(line_dedup._close(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"))).count() >= 299


def test_few_edges_make_no_shuffles(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 9), (20, 21)]
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    plans, table = [], Scratch.table

    def planned(self, df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, *args, **kwargs)

    monkeypatch.setattr(Scratch, "table", planned)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for few in (linking.FEW_EDGES, 3):
        monkeypatch.setattr(linking, "FEW_EDGES", few)
        plans.clear()
        assert {r.node: r.c for r in linking.components(df, Scratch(spark, "t"), "c").collect()} == want
        assert few == 3 or plans and not any("Exchange hashpartitioning" in p for p in plans)


def test_lines_of_other_sizes_are_not_compared(spark, monkeypatch):
    r = random.Random(12)
    passage = letters(r, 200)
    lines = [f"{letters(r, 300 + 15 * i)} {passage}" for i in range(40)]
    lines.append(lines[7] + "!")
    seen = []

    def linked(postings, verify, scratch, name, may_link, **kwargs):
        seen.append(({x.node: x.n for x in postings.collect()}, may_link))
        return linking.link_groups(postings, verify, scratch, name, may_link, **kwargs)

    monkeypatch.setattr(line_dedup, "link_groups", linked)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = [(x.kept_doc_id, x.doc_id) for x in line_dedup.duplicate_lines(docs, Scratch(spark, "t")).collect()]
    assert got == [(7, 40)]
    [(sizes, may_link)] = seen
    want = {x.node: len(char_set(lines[x.doc_id])) for x in docs.selectExpr("doc_id", "xxhash64(text) AS node").collect()}
    assert sizes and sizes.items() <= want.items()
    pairs = spark.createDataFrame([(100, 125), (125, 100), (100, 126), (126, 100), (None, 9)], "n int, m int")
    assert [x.may for x in pairs.select(may_link(F.col("n"), F.lit(0), F.col("m"), F.lit(0)).alias("may")).collect()] == [True, True, False, False, True]


def test_copies_of_very_long_lines_are_found(spark, monkeypatch):
    r = random.Random(13)
    monkeypatch.setattr(line_dedup, "VERY_LONG", 2000)
    monkeypatch.setattr(line_dedup, "FEW_HASHES", 600)
    lines = [letters(r, n) for n in (300, 580, 900, 1800, 2500, 4000)]
    lines += [line[: len(line) // 2] + "7" + line[len(line) // 2 :] for line in lines] + [lines[4][:1990].strip()]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.kept_doc_id for x in line_dedup.duplicate_lines(docs, Scratch(spark, "t")).collect()}
    similar = len(char_set(lines[12]) & char_set(lines[4])) >= 0.8 * len(char_set(lines[12]) | char_set(lines[4]))
    assert got == {6 + i: i for i in range(6)} | ({12: 4} if similar else {})
