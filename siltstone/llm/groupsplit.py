"""Problem 7: splits that keep related records together, by Boruvka-style contraction.

Nodes are rows and groups; a row has an edge to its group and, if it mirrors a row that exists, to
that row. Each round every component picks its least edge (by weight, then by name), components
hook along the picked edges, pointers are halved until each component knows its root, and the edges are renamed;
loops and doubles drop out, so the graph shrinks at least by half. The picked edges form a spanning
forest, which is written to the shared folder with every round.

The first round is one of the rows alone: each has its group as its least edge, so its root is known without a pointer, and a
group with a third of all rows is never a join key while it has an edge for each. What is left are edges between groups and rows
without one, of which each pair stands once. Least edges are aggregates, found map-side first; where many rows
look up one root, the roots of more than one in HOT_ONE_IN rows, which are fewer than that, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut

SPLITS = ("train", "val", "test")
SHARES = (0.8, 0.1, 0.1)


def relation_edges(rows: DataFrame) -> DataFrame:
    """(u, v, w) of ``rows`` (id, group, parent): 'd:<id>' to 'g:<group>' with weight 0, to 'd:<parent>' with weight 1.

    Null ids are left out; parents that aren't ids give no edge; rows repeated under one id add their edges.
    """
    node = F.concat(F.lit("d:"), "id")
    rows = rows.where("id is not null")
    grouped = rows.where("group is not null").select(node.alias("u"), F.concat(F.lit("g:"), "group").alias("v"), F.lit(0).alias("w"))
    ids = rows.select(F.col("id").alias("parent")).distinct()
    mirrored = rows.where("parent is not null and parent <> id").join(ids, "parent", "left_semi").select(node.alias("u"), F.concat(F.lit("d:"), "parent").alias("v"), F.lit(1).alias("w"))
    return grouped.unionByName(mirrored).distinct()


def _picked(edges: DataFrame) -> DataFrame:
    """Least edge (c, to, w, u, v) of each component; edges are (a, b, w, u, v) between components, u and v their first ends."""
    both = edges.select(F.col("a").alias("c"), F.col("b").alias("to"), "w", "u", "v").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("to"), "w", "u", "v"))
    least = F.min(F.struct("w", F.least("c", "to").alias("x"), F.greatest("c", "to").alias("y"), "u", "v", "to"))
    return both.groupBy("c").agg(least.alias("e")).select("c", F.col("e.to").alias("to"), F.col("e.w").alias("w"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))


HOT_ONE_IN = 1_000


def _looked_up(df: DataFrame, key: str, names: DataFrame, rows: int, out: str) -> DataFrame:
    """``df`` with ``out``: the root that ``names`` (node, root) has for ``key``, else ``key``; ``rows`` is the size of ``df``."""
    hot = cut(df.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("c")).where(F.col("c") * HOT_ONE_IN > rows).select("node"))  # fewer than HOT_ONE_IN
    names = names.select(F.col("node"), F.col("root").alias("_root"))
    few = F.broadcast(hot.join(names, "node", "left").withColumnRenamed("node", key))
    rest = df.join(F.broadcast(hot.withColumnRenamed("node", key)), key, "left_anti").join(names.withColumnRenamed("node", key), key, "left")
    return df.join(few, key).unionByName(rest).withColumn(out, F.coalesce("_root", key)).drop("_root")


def _roots(parent: DataFrame) -> DataFrame:
    """(c, root): pointers halved, twice a table, until they are roots. ``parent``: (c, to), roots pointing to themselves."""
    now = cut(parent)
    while True:
        again = now
        for _ in range(2):
            further = again.select(F.col("c").alias("to"), F.col("to").alias("next"))
            again = again.select("c", "to").join(further, "to", "left").select("c", F.coalesce("next", "to").alias("to"))
        again = cut(again.join(now.select("c", F.col("to").alias("before")), "c").select("c", "to", (F.col("to") != F.col("before")).alias("moved")))
        if again.where("moved").isEmpty():
            return again.select("c", F.col("to").alias("root"))
        now = again.select("c", "to")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest (u, v, w, round) and components (node, root) of the nodes of ``edges`` (a, b, w, u, v), a and b being the nodes and u and v what the edge is called.

    Ties of weight are broken by the names of the components, so the picked edges have no
    cycle but the pair that picked the same edge, of which the smaller name becomes the root.
    """
    now = cut(edges.where("a <> b"))
    labels = cut(now.select(F.col("a").alias("node")).union(now.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    forest = None
    number = 1
    while not now.isEmpty():
        picked = cut(_picked(now))
        tree = picked.select("u", "v", "w", F.lit(number).alias("round")).distinct()
        forest = tree if forest is None else forest.unionByName(tree)
        back = picked.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        hooked = picked.select("c", "to").join(back, ["c", "to"], "left")
        roots = _roots(hooked.select("c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
        new = roots.select(F.col("c").alias("old"), F.col("root").alias("new"))
        labels = cut(labels.join(new.withColumnRenamed("old", "root"), "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        renamed = now.join(new.select(F.col("old").alias("a"), F.col("new").alias("ra")), "a").join(new.select(F.col("old").alias("b"), F.col("new").alias("rb")), "b").where("ra <> rb")
        slim = renamed.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        now = cut(slim.select("a", "b", F.col("e.w").alias("w"), F.col("e.u").alias("u"), F.col("e.v").alias("v")))
        number += 1
    return now.select("u", "v", "w", F.lit(1).alias("round")) if forest is None else forest, labels


def spanning_forest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest (u, v, w, round) of the relations of ``rows`` (id, group, parent) and components (id, root) of their ids.

    Null ids are left out; a row without relations is its own root; rows repeated under one id add their edges. No rows, two empty frames.
    """
    edges = cut(relation_edges(rows))
    least = edges.where("w = 0").groupBy("u").agg(F.min("v").alias("v"))  # round 0: every row to its group
    ids = rows.where("id is not null").select(F.concat(F.lit("d:"), "id").alias("u")).distinct()
    first = cut(ids.join(least, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("label")))
    own, other = first.select(F.col("node").alias("u"), F.col("label").alias("a")), first.select(F.col("node").alias("v"), F.col("label").alias("lb"))
    named = edges.join(own, "u").join(other.where(~F.col("v").startswith("g:")), "v", "left").withColumn("b", F.coalesce("lb", "v")).where("a <> b")
    once = named.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e")).select("a", "b", F.col("e.w").alias("w"), F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    forest, roots = _contracted(once)
    zero = least.select("u", "v", F.lit(0).alias("w"), F.lit(0).alias("round"))
    of = _looked_up(first, "label", roots, first.count(), "root").select(F.substring("node", 3, 1 << 30).alias("id"), "root")
    return zero.unionByName(forest), of


def components(rows: DataFrame) -> DataFrame:
    """(id, root) of every id of ``rows`` (id, group, parent); a row without relations is its own root."""
    return spanning_forest(rows)[1]


def tied_across_splits(rows: DataFrame) -> DataFrame:
    """(id) of every row in a component with more than one split. ``rows``: (id, group, parent, split); a null split is none."""
    of = cut(components(rows))
    per = of.join(rows.select("id", "split").distinct(), "id").groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return of.join(per.where("lo <> hi"), "root", "left_semi").select("id").distinct()


def assign_splits(rows: DataFrame, shares: tuple[float, float, float] = SHARES) -> DataFrame:
    """(id, root, split): components go whole to train, val or test, so that the rows come to about ``shares``.

    Components of more than a hundredth of all rows, of which there are fewer than a hundred, go one by one, the largest first, to the split that lacks
    most rows. The others are stratified by size band (powers of two, largest first), ordered by hash within
    a band, and dealt systematically: the i-th takes place ``frac(i * golden ratio)`` on the unit interval, on which the
    splits have the shares they still lack. No rows, no splits; equal components are told apart by root.
    """
    of = cut(components(rows))
    total = max(1, of.count())
    sizes = cut(of.groupBy("root").agg(F.count("*").alias("n")).withColumn("large", F.col("n") > total / 100))
    lacking = [share * total for share in shares]
    placed, large = F.lit(None).cast("string"), []
    for r in sizes.where("large").orderBy(F.desc("n"), "root").collect():
        k = lacking.index(max(lacking))
        lacking[k] -= r["n"]
        placed = F.when(F.col("root") == r["root"], SPLITS[k]).otherwise(placed)
        large.append(r["root"])
    lacking = [max(0.0, x) for x in lacking]
    train, val, _ = (x / (sum(lacking) or 1.0) for x in lacking)
    banded = sizes.where("not large").select("root", F.floor(F.log2("n")).cast("int").alias("band"), F.pmod(F.xxhash64("root"), F.lit(1024)).cast("int").alias("bucket"))
    # numbers by (band, bucket) sums, at most 64 x 1024 rows, and ranks within buckets: no global sort of the roots
    sums = banded.groupBy("band", "bucket").agg(F.count("*").alias("k"))
    before = sums.withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("band"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("band", "bucket").orderBy(F.xxhash64("root", F.lit(1)), "root")
    number = F.col("base") + F.row_number().over(within)
    place = F.pmod(number * F.lit(0.6180339887498949), F.lit(1.0))
    dealt = banded.join(F.broadcast(before.select("band", "bucket", "base")), ["band", "bucket"]).select("root", F.when(place < train, SPLITS[0]).when(place < train + val, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
    whole = F.col("root").isin(large) if large else F.lit(False)  # their rows, which may be many, need no join
    return of.where(whole).select("id", "root", placed.alias("split")).unionByName(of.where(~whole).join(dealt, "root").select("id", "root", "split"))
