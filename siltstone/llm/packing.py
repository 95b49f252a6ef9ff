"""Problem 8: items of varying length in containers of fixed capacity, by minimum bin slack.

Items of one length are interchangeable, so the plan is made on counts per length, of which there are at
most ``capacity``, whatever the number of items. A container starts with the largest remaining length; a bitset
subset-sum over the remaining lengths with their counts finds the multiset that fills the rest closest to
capacity, and backtracking over the stored bitsets gives its counts. The pattern found is repeated while
the counts allow. Items get their containers by their rank within their length; ranks are taken within hash
buckets and offset by the buckets' counts, so that no task holds a length's items alone.

An item longer than the capacity fills whole containers and leaves its rest as an item.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut

ITEMS_PER_BUCKET = 100_000


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of the multiset of ``lengths`` (ascending) with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    bits = 1
    steps: list[tuple[int, int, int]] = []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left -= take
            k *= 2
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (count per length, repeats) that use up ``counts``; every length is from 1 to capacity."""
    counts = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(counts)
    out = []
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1
        pattern = best_fill(lengths, counts, capacity - largest) if capacity > largest else {}
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        repeats = min(counts[length] // k for length, k in pattern.items())
        out.append((pattern, repeats))
        for length, k in pattern.items():
            counts[length] -= k * repeats
            if not counts[length]:
                del counts[length]
                del lengths[bisect_right(lengths, length) - 1]
    return out


def containers(items: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """(pack_id, doc_id, piece_no, token_start, token_end, container_id) for ``items`` (doc_id bigint, n_tokens) and each pack.

    Items without tokens are in no container. Pieces of a cut item follow one another from token 0;
    a piece that fills a container alone names it by its item, others by the plan's number. ``packs`` is the fixed
    table of capacities; capacities below 1 are an error. No items, no rows.
    """
    if any(capacity is None or capacity < 1 for _, capacity in packs):
        raise ValueError("a capacity must be at least 1")
    spark = items.sparkSession
    items = items.where("n_tokens > 0")
    total = items.count()
    number = F.explode(F.array(*(F.struct(F.lit(i).alias("pack"), F.lit(p).alias("pack_id"), F.lit(int(c)).cast("long").alias("capacity")) for i, (p, c) in enumerate(packs))))
    each = items.select("doc_id", "n_tokens", number.alias("p")).select("doc_id", "n_tokens", "p.*")
    whole = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("long")
    each = each.withColumn("whole", whole).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    full = each.where("whole > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    full = full.select("pack_id", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("token_start"), ((F.col("piece_no") + 1) * F.col("capacity")).alias("token_end"), F.concat_ws("-", "pack_id", F.lit("item"), "doc_id", "piece_no").alias("container_id"))

    buckets = max(1, -(-total // ITEMS_PER_BUCKET))
    rest = each.where("rest > 0").select("pack", "pack_id", "doc_id", F.col("whole").cast("int").alias("piece_no"), (F.col("whole") * F.col("capacity")).alias("token_start"), F.col("rest").alias("length"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"))
    sizes = cut(rest.groupBy("pack", "length", "bucket").agg(F.count("*").alias("n")))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("pack", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    # the plan's slots in order of (pack, length, rank); the items of a (pack, length) are numbered on from those of the one before
    span = 1 + max((int(c) for _, c in packs), default=0)
    groups, firsts, starts, bases, sharers = [], [], [], [], []
    numbered = 0
    for i, (_, capacity) in enumerate(packs):
        counts = {r["length"]: r["n"] for r in sizes.where(F.col("pack") == i).groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
        used: dict[int, int] = {}
        slots: dict[int, list[tuple[int, int, int]]] = {}
        made = 0
        for pattern, repeats in plan(counts, int(capacity)):
            for length, k in pattern.items():
                slots.setdefault(length, []).append((used.get(length, 0), made, k))
                used[length] = used.get(length, 0) + k * repeats
            made += repeats
        for length in sorted(slots):
            groups.append(i * span + length)
            firsts.append(numbered)
            for first, container, k in slots[length]:
                starts.append(numbered + first)
                bases.append(container)
                sharers.append(k)
            numbered += used[length]
    shared = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in (groups, firsts, starts, bases, sharers)))

    def place(rows):
        group, number, first, base, share = shared.value
        for batch in rows:
            pack, length, rank = (batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(3))
            code = number[np.searchsorted(group, pack * span + length)] + rank
            at = np.searchsorted(first, code, "right") - 1
            container = base[at] + (code - first[at]) // share[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(container, pa.int64())], ["pack_id", "doc_id", "piece_no", "token_start", "token_end", "number"])

    rank = F.row_number().over(Window.partitionBy("pack", "length", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = rest.withColumn("rank", rank).join(before.select("pack", "length", "bucket", "base"), ["pack", "length", "bucket"])
    placed = ranked.select("pack", "length", (F.col("base") + F.col("rank")).alias("rank"), "pack_id", "doc_id", "piece_no", "token_start", (F.col("token_start") + F.col("length")).alias("token_end"))
    placed = placed.mapInArrow(place, "pack_id string, doc_id long, piece_no int, token_start long, token_end long, number long")
    return full.unionByName(placed.withColumn("container_id", F.concat_ws("-", "pack_id", "number")).drop("number"))


def fill_report(placed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """Per pack: containers, tokens and the share of room left over."""
    room = F.create_map(*(x for p, c in packs for x in (F.lit(p), F.lit(int(c)))))
    per = placed.groupBy("pack_id").agg(F.approx_count_distinct("container_id").alias("about"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"))
    exact = placed.select("pack_id", "container_id").distinct().groupBy("pack_id").agg(F.count("*").alias("n_containers"))
    return per.drop("about").join(exact, "pack_id").select("pack_id", "n_containers", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * room[F.col("pack_id")])).alias("slack_share"))
