"""Duplicates: exact by content hash, near by banded MinHash with first-wins resolution, by Hamming distance."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from siltstone.runtime import cut, shuffle_width, spread

MERSENNE = (1 << 61) - 1
MASK_32 = (1 << 32) - 1
WORDS = re.compile(r"\w+")


def exact_first_wins(df: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """``df`` with ``duplicate_of``: the first row's ``order_col`` for later rows of a hash, null for the first.

    The first of a hash is found by a partially aggregated minimum, so no task holds a hash's rows.
    """
    first = df.groupBy(hash_col).agg(F.min(order_col).alias("_first"))
    return df.join(first, hash_col).withColumn("duplicate_of", F.when(F.col(order_col) != F.col("_first"), F.col("_first"))).drop("_first")


def exact_survivors(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(hash, survivor, duplicates): least id of each hash and how many others had it."""
    return df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("survivor"), (F.count("*") - 1).alias("duplicates"))


@lru_cache
def permutations(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of ``a x + b mod 2**61 - 1``, from the 64-bit linear generator with Knuth's factors."""
    state, out = seed, []

    def draw() -> int:
        nonlocal state
        state = (6364136223846793005 * state + 1442695040888963407) % (1 << 64)
        return state

    for _ in range(n):
        a = draw() % (MERSENNE - 1) + 1
        out.append((a, draw() % MERSENNE))
    return out


@lru_cache
def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower halves of the permutations' factors, and their summands, as columns."""
    ab = np.array(permutations(n, seed), dtype=np.uint64)
    return (ab[:, :1] >> np.uint64(32)), (ab[:, :1] & np.uint64(MASK_32)), ab[:, 1:]


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod 2**61 - 1 for x below 2**63."""
    m = np.uint64(MERSENNE)
    x = (x & m) + (x >> np.uint64(61))
    x -= (x >= m) * m
    return x


def minhash_rows(shingles: np.ndarray, n_perm: int = 128, seed: int = 42) -> np.ndarray:
    """Signature of one shingle set (32-bit values); all ones of 32 bits for the empty set.

    The 93-bit products are made of two halves: a = hi 2**32 + lo, each times x stays below 2**64,
    and 2**32 is folded in by shifts modulo 2**61 - 1.
    """
    if not len(shingles):
        return np.full(n_perm, MASK_32, dtype=np.int64)
    upper, lower, b = _factors(n_perm, seed)
    x = np.asarray(shingles, dtype=np.uint64)[None, :]
    high = _fold(upper * x)  # times 2**32 to come
    # high * 2**32 mod 2**61-1: the top 32 bits of high wrap around
    wrapped = ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29))
    low = lower * x
    low = (low & np.uint64(MERSENNE)) + (low >> np.uint64(61))
    value = _fold(_fold(wrapped + low) + b)
    return (value & np.uint64(MASK_32)).min(axis=1).astype(np.int64)


def shingle_values(text: str, k: int = 5) -> np.ndarray:
    """Distinct 32-bit hashes of the k-word shingles of a text, as the column expression has them."""
    words = WORDS.findall(text.lower())
    grams = {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())
    return np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "big") for g in grams], dtype=np.uint64)


def minhash_signature(text, k: int = 5, n_perm: int = 128):
    """Signature column of a text column; null for texts without words, whose signatures would all be equal."""

    @F.pandas_udf(ArrayType(LongType()))
    def sign(texts: pd.Series) -> pd.Series:
        out = (shingle_values(t, k) if t is not None else [] for t in texts)
        return pd.Series([minhash_rows(v, n_perm) if len(v) else None for v in out], dtype=object)

    return sign(text)


def estimated_jaccard(a, b):
    """Share of equal positions of two signatures of one length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), same / F.size(a))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """(id, sig) of each text; texts without words have no signature here (they'd all be equal)."""
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), minhash_signature(F.col(text_col), k).alias("sig")).where("sig is not null")


def _nodes(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, sig, node) of each row, and (node, sig, rep) of each distinct signature with its least id."""
    keyed = cut(sig.withColumn("node", F.xxhash64("sig")))
    return keyed, cut(keyed.groupBy("node").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("rep")))


def _band_keys(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows))))
    return nodes.select("node", band.alias("key"))


def met_within(keys: DataFrame, block: int = 4_000) -> DataFrame:
    """(m, n), m < n: distinct pairs of nodes with a key in common. ``keys``: (node, key).

    Keys on more than two blocks of nodes are split: their nodes fall into blocks by hash, and each pair of blocks is a key of its own.
    """
    hot = cut(keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > 2 * block).select("key", F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    rows = keys.select("key", "node", F.lit(0).alias("own"), F.lit(0).alias("other"))
    if not hot.isEmpty():
        cells = keys.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.join(hot, "key", "left_anti").unionByName(cells.select("key", "node", "own", "other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("node", "own", F.struct("key", low.alias("lo"), high.alias("hi")).alias("cell"))
    x, y = rows.alias("x"), rows.alias("y")
    # a pair of one block meets in the block's own cell, a pair of two blocks in theirs
    same_place = F.expr("x.cell = y.cell and x.node < y.node and (x.own <> y.own or x.cell.lo = x.cell.hi)")
    return x.join(y, same_place).select(F.col("x.node").alias("m"), F.col("y.node").alias("n")).distinct()


def banded_pairs(sig: DataFrame, bands: int = 16, rows: int = 8, least: float = 0.8) -> DataFrame:
    """(a, b, similarity), a < b, of signatures that agree in a band and in at least ``least`` of all positions.

    Equal signatures are one node of the join (their pairs come from the group's least id), so copies don't
    multiply the band buckets. That is enough for ``first_wins`` only; between two tables use ``best_matches``.
    """
    keyed, nodes = _nodes(sig)
    keys = _band_keys(nodes, bands, rows)
    met = met_within(keys)
    left, right = nodes.select(F.col("node").alias("m"), F.col("sig").alias("sa")), nodes.select(F.col("node").alias("n"), F.col("sig").alias("sb"))
    scored = met.join(left, "m").join(right, "n").select("m", "n", estimated_jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)
    a, b = keyed.select(F.col("node").alias("m"), F.col("id").alias("i")), keyed.select(F.col("node").alias("n"), F.col("id").alias("j"))
    across = scored.join(a, "m").join(b, "n").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")
    same = keyed.join(nodes.select("node", "rep"), "node").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def best_matches(left: DataFrame, right: DataFrame, bands: int = 16, rows: int = 8, least: float = 0.8) -> DataFrame:
    """(id, match, similarity): each ``left`` id's most similar ``right`` id (ties: least id) among those that agree in a band and in ``least`` of all positions.

    Equal signatures are one node on each side: copies multiply neither buckets nor pairs, and every left id of a node gets the node's match.
    """
    (keyed, ours), (_, theirs) = _nodes(left), _nodes(right)
    x, y = _band_keys(ours, bands, rows).withColumnRenamed("node", "m"), _band_keys(theirs, bands, rows).withColumnRenamed("node", "n")
    met = x.join(y, "key").select("m", "n").distinct()
    a, b = ours.select(F.col("node").alias("m"), F.col("sig").alias("sa")), theirs.select(F.col("node").alias("n"), F.col("sig").alias("sb"), "rep")
    scored = met.join(a, "m").join(b, "n").select("m", F.col("rep").alias("match"), estimated_jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)
    best = F.min_by(F.struct("match", "similarity"), F.struct(F.negative("similarity"), F.col("match"))).alias("best")
    per_node = scored.groupBy(F.col("m").alias("node")).agg(best).select("node", "best.*")
    return keyed.join(per_node, "node").groupBy("id").agg(best).select("id", "best.*")


def first_wins(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, duplicate_of): a row is dropped iff a kept row of smaller id is similar to it; null for kept rows.

    The sequential rule "compare with kept rows only, in order of id", by rounds: a row whose smaller neighbours are all
    dropped is kept; a row with a kept smaller neighbour is dropped. Each round settles at least the least open row
    of every component. ``pairs``: (a, b, similarity) with a < b. ``duplicate_of`` is the most similar kept one (ties: least id).
    The states are never broadcast: as Parquet they are so small that each round would send all rows through the driver.
    """
    edges = cut(pairs.select("a", "b", "similarity"))
    touched = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    state = cut(touched.withColumn("state", F.lit("open")))  # rows without a neighbour are kept as they are

    def settled(state: DataFrame) -> DataFrame:
        by_a = edges.join(state.select(F.col("id").alias("a"), F.col("state").alias("sa")).hint("merge"), "a")
        seen = by_a.groupBy(F.col("b").alias("id")).agg(F.max(F.col("sa") == "kept").alias("kept_before"), F.max(F.col("sa") == "open").alias("open_before"))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("kept_before"), "dropped").when(F.coalesce("open_before", F.lit(False)), "open").otherwise("kept")
        return state.join(seen.hint("merge"), "id", "left").select("id", new.alias("state"))

    while not state.where("state = 'open'").isEmpty():
        state = cut(settled(settled(state)))  # two rounds a table
    kept = state.where("state = 'kept'").select(F.col("id").alias("a"))
    best = edges.join(kept.hint("merge"), "a").groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct(F.negative("similarity"), F.col("a"))).alias("best"))
    dropped = state.where("state = 'dropped'").join(best.hint("merge"), "id").select("id", F.col("best").alias("duplicate_of"))
    return ids.select("id").join(dropped.hint("merge"), "id", "left")


def hamming_pairs(hashes: DataFrame, most: int = 6, agree: int = 3) -> DataFrame:
    """(a, b, distance), a < b, of 64-bit hashes at most ``most`` bits apart. ``hashes``: (id, hash); ids are unique, null hashes match nothing.

    Of ``most + agree`` blocks of bits two hashes that near have ``agree`` in common at least, so every choice of that
    many blocks is a join key. Equal hashes are one node; their rows are paired at the end.
    """
    keyed = cut(hashes.where("hash is not null").select("id", "hash"))
    near = _near_nodes(cut(keyed.select(F.col("hash").alias("node")).distinct()), most, agree)
    a, b = (keyed.select(F.col("hash").alias(h), F.col("id").alias(i)).hint("merge") for h, i in (("m", "i"), ("n", "j")))
    across = near.join(a, "m").join(b, "n").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")
    several = keyed.groupBy("hash").count().where("count > 1").select("hash")
    twins = keyed.join(several.hint("merge"), "hash", "left_semi")
    within = twins.alias("x").join(twins.alias("y").hint("merge"), F.expr("x.hash = y.hash and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(0).alias("distance"))
    return across.unionByName(within)


def _near_nodes(nodes: DataFrame, most: int, agree: int, block: int = 4_000) -> DataFrame:
    """(m, n, distance), m < n: pairs of distinct ``node`` at most ``most`` bits apart, each once.

    A pair counts at the first of its common keys only, so those met need no shuffle to be made distinct. Keys are never
    broadcast: Catalyst sizes them as their nodes, of which each has dozens. Keys on more than two blocks of nodes are split as in ``met_within``.
    """
    blocks, spark = _bit_blocks(most + agree), nodes.sparkSession
    bits = (len(blocks) - 1).bit_length()
    masked = [(F.lit(_signed(sum(blocks[k] for k in chosen))), chosen[-1]) for chosen in combinations(range(len(blocks)), agree)]
    # the low bits of a key are the last block of its choice
    key = F.array(*(F.shiftleft(F.xxhash64(mask, F.col("node").bitwiseAND(mask)), bits).bitwiseOR(F.lit(last).cast("long")) for mask, last in masked))
    keys = spread(nodes).select("node", F.explode(key).alias("key"))
    width = shuffle_width(spark, nodes.count() * len(masked))

    differ = F.col("x.node").bitwiseXOR(F.col("y.node"))
    last = F.col("x.key").bitwiseAND(F.lit((1 << bits) - 1))
    common = sum((((last >= k) & (differ.bitwiseAND(F.lit(_signed(mask))) == 0)).cast("int") for k, mask in enumerate(blocks)), F.lit(0))
    close = (F.col("x.node") < F.col("y.node")) & (F.bit_count(differ) <= most) & (common == agree)

    def met(rows: DataFrame, *same: str) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y").hint("merge")
        return x.join(y, F.expr(" and ".join(same)) & close).select(F.col("x.node").alias("m"), F.col("y.node").alias("n"), F.bit_count(differ).alias("distance"))

    hot = _hot_keys(keys, block)
    if hot is None:
        return met(keys.repartition(width, "key"), "x.key = y.key")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    cells = keys.join(hot, "key").select("node", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = keys.join(hot, "key", "left_anti").repartition(width, "key")
    return met(rest, "x.key = y.key").unionByName(met(cells, "x.key = y.key", "x.own = y.other", "x.other = y.own"))


def _hot_keys(keys: DataFrame, block: int, buckets: int = 1 << 20) -> DataFrame | None:
    """(key, blocks) of the keys on more than two blocks of nodes, None if there are none. Only buckets of keys with as many rows are counted key by key."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    full = cut(keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c")).where(F.col("c") > 2 * block).select("bucket"))
    if full.isEmpty():
        return None
    counts = keys.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy("key").agg(F.count("*").alias("c"))
    hot = cut(counts.where(F.col("c") > 2 * block).select("key", F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    return None if hot.isEmpty() else hot


def _bit_blocks(blocks: int) -> list[int]:
    """Masks that cut 64 bits into blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    """64 bits as the signed number that a bigint holds."""
    return x - (1 << 64) if x >> 63 else x


def hamming_first_wins(hashes: DataFrame, most: int = 6) -> DataFrame:
    """(id, duplicate_of): a row is dropped iff a kept row of smaller id is at most ``most`` bits away; the nearest of those, ties the least id.

    Copies of a hash follow their first row, so only distinct hashes are compared. Rows without a hash are kept.
    """
    first = cut(hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id")))
    pairs = hamming_pairs(first, most).withColumn("similarity", 1 - F.col("distance") / 64)
    per = first_wins(first, pairs).join(first.hint("merge"), "id").select("hash", F.col("id").alias("_first"), "duplicate_of")
    out = hashes.join(per.hint("merge"), "hash", "left")
    return out.select("id", F.when(F.col("_first").isNull(), None).otherwise(F.coalesce("duplicate_of", F.when(F.col("id") != F.col("_first"), F.col("_first")))).alias("duplicate_of"))


def overlap_report(docs: DataFrame, protected: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(outcome, n) over ``docs``: every copy of a protected hash is ``overlaps_training``, else all but the least id ``duplicate``, else ``written``."""
    known = protected.select(hash_col).distinct().withColumn("_known", F.lit(True))
    marked = exact_first_wins(docs, hash_col, id_col).join(known, hash_col, "left")
    outcome = F.when(F.col("_known"), "overlaps_training").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("written")
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def ranks_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
