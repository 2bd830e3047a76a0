"""Links and components by DataFrame operations only: candidate groups, stars before pairs, and union-find as star joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rounds in which each group is compared with one of its members, before all pairs that are left.
STAR_ROUNDS = 3
#: Edges up to which a component step is one task without shuffles (4 MB); more edges are dealt out.
FEW_EDGES = 1 << 18


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, c: the smallest node of each node's component, for the nodes of edges (a, b).

    Alternating star joins (large star, small star), which are distributed union-find: each step hangs a node's
    neighbours under the smallest one, until every component is one star; the steps follow the logarithm of its size.
    Each step is a written table. A node with very many neighbours is a join of rows with one key, which Spark splits. Few
    edges stay in one task, as the driver keeps something of each task that has run.
    """
    few = edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES

    def together(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    now = together(scratch.table(together(edges).select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct(), f"{name}-0", small=True))
    state, step = _state(now), 0
    while state[0]:
        step += 1
        both = together(now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = together(large.join(least, "u").filter("v != m").select(F.least("v", "m").alias("v"), F.greatest("v", "m").alias("u")).unionByName(least.select(F.col("m").alias("v"), "u"))).distinct()
        now = together(scratch.table(small, f"{name}-{step}", small=True))
        scratch.drop(f"{name}-{step - 1}")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("c")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("c")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def link_groups(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str, may_link: Callable[..., Column], pairs: DataFrame | None = None, details: DataFrame | None = None, alike: Callable[..., Column] | None = None, few: int = 0, rest: Callable[[DataFrame], DataFrame] | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None, rounds: int | None = None) -> DataFrame:
    """Components (node, c) of the nodes that verified links join, over all pairs of nodes with a token in common.

    postings: tok, node, n (the node's size), pos (the token's place in the node's order), each (tok, node) once. verify:
    pairs (a, b) -> those that are linked. may_link(n, pos, other n, other pos): whether a token that stands there may be
    the first one that two linked nodes have in common. Two nodes of the same component need not be compared any more. So
    each group is first compared with the member in which the token comes first, which differs least from the others,
    round by round: a group of copies then is one component after as many comparisons as it has members. In each round,
    groups of at most few rows are compared as a whole, so that they are closed. A group is open as long as its rows are
    of different components. All pairs that may be linked and are of different components after the last round are
    compared in the end; none is left out. Pairs (a, b) that were found in another way are compared before. details (node
    and more columns) and alike, a condition on the details of two nodes (functions from a name to a column), keep pairs
    that are not alike from being made. rest makes the last pairs of the rows of open groups (tok, node, c, details). narrow
    leaves out pairs before they are verified; rounds is the number of rounds, STAR_ROUNDS if not given.
    """
    links: list[DataFrame] = []
    tested: list[DataFrame] = []
    comp: DataFrame | None = None

    more = [] if details is None else [c for c in details.columns if c != "node"]
    own = ["tok", "node", "n", "pos", *more]

    def joined(p: DataFrame) -> DataFrame:
        if comp is None:
            return p.withColumn("c", F.col("node"))
        return p.join(comp, "node", "left").select(*own, F.coalesce("c", "node").alias("c"))

    def are_alike(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        return F.lit(True) if alike is None else alike(x, y)

    def compare(pairs: DataFrame, step: str) -> bool:
        nonlocal comp
        pairs = pairs.distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"{name}-pairs-{step}", small=True)
        if pairs.isEmpty():
            return False
        tested.append(pairs)
        if narrow is not None:
            pairs = scratch.table(narrow(pairs), f"{name}-near-{step}", small=True)
            if pairs.isEmpty():
                return False
        found = scratch.table(verify(pairs), f"{name}-links-{step}", 500, small=True)
        if found.isEmpty():
            return False
        links.append(found)
        # earlier links are what their components say
        edges = found if comp is None else found.unionByName(comp.select(F.col("node").alias("a"), F.col("c").alias("b")))
        comp = components(edges, scratch, f"{name}-comp-{step}")
        scratch.release()
        return True

    def all_pairs(j: DataFrame) -> DataFrame:
        a, b = (j.select("tok", *(F.col(c).alias(f"{c}_{x}") for c in j.columns if c != "tok")) for x in "ab")
        may = may_link(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")) & are_alike(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
        return a.join(b, "tok").filter((F.col("node_a") < F.col("node_b")) & (F.col("c_a") != F.col("c_b")) & may).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    def opened(j: DataFrame) -> DataFrame:
        return j.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("pos", "n", "node", "c", *more)).alias("lead"), F.count("*").alias("rows")).filter("lo != hi").select("tok", "lead", "rows")

    if pairs is not None:
        compare(pairs, "given")
    p = postings if details is None else postings.join(details, "node").select(*own)
    for k in range(STAR_ROUNDS if rounds is None else rounds):
        j = joined(p)
        groups = opened(j)
        met = scratch.table(j.join(groups, "tok"), f"{name}-open-{k}", small=True)
        if k:
            scratch.drop(f"{name}-open-{k - 1}")
        if met.isEmpty():
            break
        large = met.filter((F.col("rows") > few) & (F.col("node") != F.col("lead.node")))
        may = may_link(F.col("lead.n"), F.col("lead.pos"), F.col("n"), F.col("pos")) & are_alike(lambda c: F.col(f"lead.{c}"), F.col)
        asked = large.filter((F.col("c") != F.col("lead.c")) & may).select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b"))
        if few:
            asked = asked.unionByName(all_pairs(met.filter(F.col("rows") <= few).select(*own, "c")))
        compare(asked, f"star{k}")
        p = large.select(*own)
    else:
        j = scratch.table(joined(p), f"{name}-joined", small=True)
        left = j.join(opened(j).select("tok"), "tok", "left_semi")
        compare(all_pairs(left) if rest is None else rest(left), "rest")
    if comp is None:
        return postings.sparkSession.createDataFrame([], "node long, c long")
    return comp
