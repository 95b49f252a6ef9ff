"""Regimes, drift, decisions, gates, registry and feedback folds, benchmark parsers, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PSI_MINOR, PSI_SIGNIFICANT, LEAST_SAMPLES, EPS = 0.10, 0.25, 200, 1e-6
TRANSITIONS = [("submitted", "under_review"), ("submitted", "unverifiable"), ("under_review", "verified"), ("under_review", "rejected"), ("under_review", "unverifiable")]
TERMINAL = ["verified", "rejected", "unverifiable"]


# ---- regimes ----
def group_keys(df: DataFrame, group: str, key: Column, pos: str, neutral: str) -> DataFrame:
    """(group, key): the first key of a group that isn't neutral, else the neutral one."""
    value = F.coalesce(key, F.lit(neutral))
    return df.groupBy(group).agg(F.min_by(value, F.struct((value == neutral).alias("n"), F.col(pos))).alias("key"))


def held_out(df: DataFrame, group: str, key: Column, pos: str, test_keys: list[str], neutral: str = "") -> DataFrame:
    """``df`` with ``side``: test for all rows of groups whose key is held out, else train. Human text can't be held out as a generator."""
    if neutral == "human" and "human" in test_keys:
        raise ValueError("human is not a generator family to hold out")
    keys = group_keys(df, group, key, pos, neutral)
    return df.join(keys, group).withColumn("side", F.when(F.col("key").isin(test_keys), "test").otherwise("train")).drop("key")


def release_key(released: Column, cutoff: str) -> Column:
    """none, before or after the cutoff, comparing release dates as strings."""
    return F.when(F.coalesce(released, F.lit("")) == "", "none").when(released > cutoff, "after").otherwise("before")


# ---- drift ----
def histogram(df: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0, by: list[str] = ()) -> DataFrame:
    """(by, bin, n): equal bins, the last closed, values outside left out; empty bins are absent."""
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col(value) - lo) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def divergences(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """psi and kl(current || reference) of two histograms (bin, n); shares of empty bins count as 1e-6."""
    every = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    share = lambda h, name: every.join(h, "bin", "left").select("bin", F.greatest(F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(0)), F.lit(1)), F.lit(EPS)).alias(name))
    both = share(reference, "e").join(share(current, "a"), "bin")
    log = F.ln(F.col("a") / F.col("e"))
    return both.agg(F.sum((F.col("a") - F.col("e")) * log).alias("psi"), F.sum(F.col("a") * log).alias("kl"))


def drift_report(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """One row: psi, kl, means, counts and severity; below 200 samples on either side it is unmeasurable."""
    d = divergences(histogram(reference, value, bins, lo, hi), histogram(current, value, bins, lo, hi), bins)
    r = reference.agg(F.count(value).alias("n_reference"), F.avg(value).alias("reference_mean"))
    c = current.agg(F.count(value).alias("n_current"), F.avg(value).alias("current_mean"))
    one = d.crossJoin(r).crossJoin(c)  # three one-row frames
    ok = F.least("n_reference", "n_current") >= LEAST_SAMPLES
    severity = F.when(~ok, "unmeasurable").when(F.col("psi") >= PSI_SIGNIFICANT, "significant").when(F.col("psi") >= PSI_MINOR, "minor").otherwise("stable")
    return one.select(F.when(ok, F.col("psi")).alias("psi"), F.when(ok, F.col("kl")).alias("kl"), "reference_mean", "current_mean", "n_reference", "n_current", severity.alias("severity"))


def diagnosis(score_psi: Column, input_psi: Column) -> Column:
    """model_or_deploy, traffic, insensitive_or_stuck, stable or insufficient_data."""
    s, i = score_psi >= PSI_MINOR, input_psi >= PSI_MINOR
    return F.when(score_psi.isNull() | input_psi.isNull(), "insufficient_data").when(s & ~i, "model_or_deploy").when(s & i, "traffic").when(i, "insensitive_or_stuck").otherwise("stable")


# ---- decisions ----
def decision(score: Column, threshold: float, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """(verdict, confidence): uncertain inside [low, high), else ai from the threshold on; confidence is the distance from it."""
    if (low is None) != (high is None):
        raise ValueError("low and high are set together")
    if low is not None and not low <= threshold <= high:
        raise ValueError("the threshold must lie in the uncertain band")
    verdict = F.when(score >= threshold, "ai").otherwise("human")
    if low is not None:
        verdict = F.when((score >= low) & (score < high), "uncertain").otherwise(verdict)
    return verdict, F.abs(score - threshold) / max(threshold, 1 - threshold)


def softmax_ai(human_logit: Column, ai_logit: Column, temperature: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp((human_logit - ai_logit) / temperature))


def release_gate(metrics: DataFrame, gate: dict[str, float], no_regression: list[str] = (), baseline: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, limit, failed) for every gated metric; a missing metric fails. ``metrics``: (metric, value)."""
    upper = {"max_fpr": "fpr", "max_fnr": "fnr", "max_ece": "ece", "max_p95_latency_ms": "p95_latency_ms"}
    rows = [(upper[k], float(v), "at_most") for k, v in gate.items() if k in upper] + [("ood_auroc", float(v), "at_least") for k, v in gate.items() if k == "min_ood_auroc"]
    rows += [(r, float((baseline or {})[r]), "at_least") for r in no_regression if r in (baseline or {})]
    limits = metrics.sparkSession.createDataFrame(rows, "metric string, limit double, kind string")
    failed = F.when(F.col("kind") == "at_most", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return limits.join(metrics, "metric", "left").select("metric", "value", "limit", F.coalesce(failed, F.lit(True)).alias("failed"))


# ---- feedback ----
def transition_faults(events: DataFrame) -> DataFrame:
    """Events (item, pos, to, verifier, label) with ``state`` before them and ``fault``: illegal or unverified_label, null if legal.

    An illegal event doesn't move its item; items are submitted first. The fold runs per item over its sorted
    events, whose number is small by nature (terminal states end it).
    """
    first = F.struct(F.lit("submitted").alias("state"), F.array().cast("array<struct<pos:bigint,state:string,fault:string>>").alias("log"))
    legal = lambda a, b: F.concat(a, F.lit(">"), b).isin([f"{x}>{y}" for x, y in TRANSITIONS])

    def step(acc, e):
        fault = F.when(~legal(acc["state"], e["to"]), "illegal").when((e["to"] == "verified") & (e["verifier"].isNull() | e["label"].isNull()), "unverified_label")
        entry = F.struct(e["pos"].alias("pos"), acc["state"].alias("state"), fault.alias("fault"))
        return F.struct(F.when(fault.isNull(), e["to"]).otherwise(acc["state"]).alias("state"), F.concat(acc["log"], F.array(entry)).alias("log"))

    ordered = events.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), "to", "verifier", "label"))).alias("e"))
    return ordered.select("item", F.aggregate("e", first, step).alias("r"))


def feedback_stats(states: DataFrame) -> DataFrame:
    """(total, pending, reviewed, rejection_rate) over (item, state)."""
    reviewed = F.count_if(F.col("state").isin(TERMINAL))
    return states.agg(F.count("*").alias("total"), F.count_if(~F.col("state").isin(TERMINAL)).alias("pending"), reviewed.alias("reviewed"), F.bround(F.coalesce(F.try_divide(F.count_if(F.expr("state = 'rejected'")), reviewed), F.lit(0.0)), 4).alias("rejection_rate"))


# ---- benchmark parsers: the columns of each source are a contract ----
RAID = ["id", "adv_source_id", "source_id", "model", "decoding", "repetition_penalty", "attack", "domain", "title", "prompt", "generation"]
MAGE = ["text", "label", "src"]
HC3 = ["id", "question", "human_answers", "chatgpt_answers", "source"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def parse_raid(rows: DataFrame, excluded: list[str] = ("code", "czech", "german"), include_attacks: bool = True) -> DataFrame:
    domain = F.lower(F.coalesce("domain", F.lit("")))
    attack = F.coalesce(F.nullif(F.col("attack"), F.lit("")), F.lit("none"))
    out = require(rows, RAID).where(~domain.isin(*excluded))
    if not include_attacks:
        out = out.where(attack == "none")
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return out.select(
        F.col("id").cast("string").alias("doc_id"), F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), F.col("id").cast("string")).alias("group_id"), F.coalesce("generation", F.lit("")).alias("text"),
        F.when(F.col("model") == "human", 0).otherwise(1).alias("label"), F.lit("raid").alias("benchmark"), known(domain).alias("domain"), known(F.col("model")).alias("model"), attack.alias("attack"),
    )


def parse_mage(rows: DataFrame, ordinal: str, machine_label: int = 0) -> DataFrame:
    """Machine text has label 0 in this source. ``ordinal``: the row's position, which names it."""
    name = F.concat(F.lit("mage_"), F.col(ordinal))
    return require(rows, MAGE).select(name.alias("doc_id"), name.alias("group_id"), "text", F.when(F.col("label") == machine_label, 1).otherwise(0).alias("label"), F.lit("mage").alias("benchmark"), F.lit("unknown").alias("domain"), F.coalesce("src", F.lit("unknown")).alias("model"), F.lit("none").alias("attack"))


def parse_hc3(rows: DataFrame) -> DataFrame:
    """One row per answer of either list, blank ones left out; all answers to a question share a group."""
    rows = require(rows, HC3)
    group = F.concat(F.lit("hc3_q"), F.col("id").cast("string"))

    def side(column: str, kind: str, label: int) -> DataFrame:
        text = F.trim(F.col("a"))
        return rows.select("*", F.posexplode(column).alias("j", "a")).where(text != "").select(
            F.concat(group, F.lit(f"_{kind}_"), F.col("j")).alias("doc_id"), group.alias("group_id"), text.alias("text"), F.lit(label).alias("label"), F.lit("hc3").alias("benchmark"), F.coalesce("source", F.lit("unknown")).alias("domain"), F.lit(kind).alias("model"), F.lit("none").alias("attack")
        )

    return side("human_answers", "human", 0).unionByName(side("chatgpt_answers", "chatgpt", 1))


# ---- contamination ----
def exact_contamination(eval_docs: DataFrame, train: DataFrame, hash_col: str) -> DataFrame:
    """(eval_id, train_id): evaluation rows whose hash occurs in train, with the least id there. Inputs: (id, hash)."""
    first = train.groupBy(hash_col).agg(F.min("id").alias("train_id"))
    return eval_docs.join(first, hash_col).select(F.col("id").alias("eval_id"), "train_id")


def contamination_report(eval_docs: DataFrame, train: DataFrame, hash_col: str) -> DataFrame:
    """One row: distinct training hashes, evaluation rows, how many of them stand in train, and whether none does. Inputs: (id, hash)."""
    known = train.groupBy(hash_col).agg(F.lit(True).alias("_met"))
    per = eval_docs.join(known, hash_col, "left").agg(F.count("*").alias("n_eval"), F.count("_met").alias("exact_overlap"))
    n = known.agg(F.count("*").alias("n_train"))
    return n.crossJoin(per).withColumn("clean", F.col("exact_overlap") == 0)  # two one-row frames


def require_clean(report: DataFrame, benchmark: str) -> None:
    row = report.first()
    if not row["clean"]:
        raise ValueError(f"{benchmark} is contaminated: {row['exact_overlap']} of {row['n_eval']} rows stand in train")


def group_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split."""
    per = df.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("n_splits"))
    return per.where("n_splits > 1")
