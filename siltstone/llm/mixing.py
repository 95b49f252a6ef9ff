"""Problem 9: sources mixed to target shares, by pivotal dependent rounding.

A source with ``t`` target tokens and ``a`` tokens uses each of its documents ``x = min(t / a, max_repeats)`` times: ``floor(x)``
copies for certain and one more with the fraction. Fractions are rounded in pairs: token mass moves at random
from one document to the other until one of them is 0 or 1, so every document keeps its probability and a pair its tokens.
Documents are rounded in leaves of bounded size; each leaf leaves at most one fraction, and the residuals of
leaves are paired again, level by level, up to one per source, which is drawn at last. A source thus comes within
one document of its target.

A source without enough tokens at ``max_repeats`` (or without documents) is short, and what it lacks must show somewhere. With
``keep="size"`` short sources give all they may and the others are raised, by their shares, until the size is
reached or all are short; with ``keep="shares"`` the mix is made smaller until every source that has documents reaches its
share (over the shares of those that have any), however small that is. Shares and sizes asked, aimed at and reached are reported.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut

LEAF = 2_000
FAN = 500
SEED = 20_240


def round_pairs(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounded fractions and the index of the one left fractional (-1 for none); the sum of ``p * size`` is kept."""
    out = p.astype(float).copy()
    draws = rng.random(len(out))
    held = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, s, r = out[held], out[i], size[held], size[i]
        up, down = min((1 - a) * s, b * r), min(a * s, (1 - b) * r)  # mass to held, mass from held
        if draws[i] * (up + down) < down:
            if (1 - a) * s <= b * r:
                a, b = 1.0, b - up / r
            else:
                a, b = a + up / s, 0.0
        elif a * s <= (1 - b) * r:
            a, b = 0.0, b + down / r
        else:
            a, b = a - down / s, 1.0
        # sums end on 0 or 1 but for rounding of the last bits
        out[held], out[i] = (x if 1e-12 < x < 1 - 1e-12 else round(x) for x in (a, b))
        held = next((k for k in (held, i) if 0.0 < out[k] < 1.0), -1)
    return out, held


def _round_leaf(level: int, last: bool):
    def leaf(key, rows):
        rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{SEED}|{level}|{'|'.join(map(str, key))}"))
        p, held = round_pairs(rows["p"].to_numpy(), rows["n_tokens"].to_numpy(float), rng)
        if last and held >= 0:
            p[held] = float(rng.random() < p[held])
        rows["p"] = p
        return rows[["mix_id", "source", "doc_id", "n_tokens", "copies", "p", "leaf"]]

    return leaf


def aimed(sources: list[tuple[float, float]], asked: float, keep: str) -> list[float]:
    """Tokens to aim at for the (share, most tokens) of each source of a mix of ``asked`` tokens."""
    out = [0.0] * len(sources)
    open_ = [i for i, (share, most) in enumerate(sources) if share > 0 and most > 0]
    whole = sum(sources[i][0] for i in open_)
    if keep == "shares":
        size = min([asked, *(sources[i][1] * whole / sources[i][0] for i in open_)])
        for i in open_:
            out[i] = min(sources[i][1], size * sources[i][0] / whole)
        return out
    left = asked
    while open_:
        whole = sum(sources[i][0] for i in open_)
        short = [i for i in open_ if sources[i][1] < left * sources[i][0] / whole]
        for i in short or open_:
            out[i] = sources[i][1] if short else left * sources[i][0] / whole
        if not short:
            break
        left -= sum(out[i] for i in short)
        open_ = [i for i in open_ if i not in short]
    return out


def mixed(docs: DataFrame, targets: DataFrame, keep: str = "size") -> tuple[DataFrame, DataFrame]:
    """Chosen documents (mix_id, source, doc_id, n_tokens, repeats) and goals (mix_id, source, target_share, max_repeats, target_tokens, goal_tokens, n_tokens).

    ``docs``: (doc_id, source, n_tokens) with sources as in ``targets`` (mix_id, source, target_share, max_repeats, total_factor),
    a small fixed table. Documents without source or tokens count for the total only. ``keep``: shares or size, for mixes with short
    sources. A null share is 0, a null max_repeats 1, a null total_factor 1; a source named twice in a mix has the sum of its shares and the
    least max_repeats; a null mix or source is left out.
    """
    if keep not in ("shares", "size"):
        raise ValueError(f"keep is shares or size, not {keep!r}")
    spark = docs.sparkSession
    docs = cut(docs)
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    per = docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    merged = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max(F.coalesce("total_factor", F.lit(1.0))).alias("total_factor")
    )
    wanted = merged.join(per, "source", "left").select("mix_id", "source", "target_share", "max_repeats", "total_factor", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    mixes: dict[str, list] = {}
    for r in wanted.orderBy("mix_id", "source").collect():  # as many rows as ``targets``
        mixes.setdefault(r["mix_id"], []).append(r)
    rows = []
    for mix_id, own in mixes.items():
        asked = max(r["total_factor"] for r in own) * total
        goals = aimed([(r["target_share"], float(r["n_tokens"] * r["max_repeats"])) for r in own], asked, keep)
        rows += [(mix_id, r["source"], r["target_share"], r["max_repeats"], r["target_share"] * asked, goal, r["n_tokens"], r["n_docs"]) for r, goal in zip(own, goals)]
    goals = spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int, target_tokens double, goal_tokens double, n_tokens long, n_docs long")
    x = F.least(F.col("goal_tokens") / F.col("have"), F.col("max_repeats").cast("double"))
    rate = goals.where("n_tokens > 0").select("mix_id", "source", "max_repeats", "goal_tokens", F.col("n_tokens").alias("have"), "n_docs").withColumn("x", x)
    rate = rate.select("mix_id", "source", F.floor("x").cast("int").alias("copies"), (F.col("x") - F.floor("x")).alias("p"), F.ceil(F.col("n_docs") / LEAF).cast("int").alias("leaves"))
    rows = docs.where("n_tokens > 0").join(F.broadcast(rate), "source")
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "mix_id"), F.col("leaves").cast("long")).cast("int")).select("mix_id", "source", "doc_id", "n_tokens", "copies", "p", "leaf")
    leaves = rate.agg(F.coalesce(F.max("leaves"), F.lit(1))).first()[0]
    schema = "mix_id string, source string, doc_id long, n_tokens long, copies int, p double, leaf int"
    done, level = [], 0
    while True:
        last = leaves == 1
        rows = cut(rows.groupBy("mix_id", "source", "leaf").applyInPandas(_round_leaf(level, last), schema))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rows.where(~open_))
        if last:
            break
        rows, leaves, level = rows.where(open_).withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("int")), -(-leaves // FAN), level + 1
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionByName(more)
    repeats = (F.col("copies") + F.round("p").cast("int")).alias("repeats")
    return chosen.select("mix_id", "source", "doc_id", "n_tokens", repeats).where("repeats > 0"), goals.drop("n_docs")


def share_report(chosen: DataFrame, goals: DataFrame) -> DataFrame:
    """Per mix and source: share and tokens asked, aimed at and reached, tokens of the whole mix, documents used, and whether the source is short of its asked tokens."""
    used = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("n_docs"))
    sums = used.groupBy("mix_id").agg(F.sum("actual_tokens").alias("mix_tokens"))
    both = goals.join(used, ["mix_id", "source"], "left").join(sums, "mix_id", "left")
    actual = F.coalesce("actual_tokens", F.lit(0))
    whole = Window.partitionBy("mix_id")  # as many rows as the mix has sources
    return both.select(
        "mix_id", "source", "target_share", F.coalesce(F.try_divide(actual, F.col("mix_tokens")), F.lit(0.0)).alias("actual_share"), F.coalesce(F.try_divide(F.col("goal_tokens"), F.sum("goal_tokens").over(whole)), F.lit(0.0)).alias("goal_share"), "target_tokens", "goal_tokens", actual.alias("actual_tokens"),
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.col("n_tokens") * F.col("max_repeats") < F.col("target_tokens")).alias("short"),
    )
