"""Reports over results: headline, checkpoint choice, label evidence, rosters, manifests and captions of image records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hashing import hex_number

# ---- fixed values ----
GENERATOR_MARKERS = ["gpt", "llama", "opt", "flan", "t5", "bloom", "glm", "dolly", "vicuna", "alpaca", "koala", "stablelm", "cohere", "davinci", "chatgpt", "gpt-j", "gpt-neo", "mixtral", "mistral", "falcon", "claude", "palm", "bard", "machine", "generated", "fake"]
HUMAN_MARKERS = ["human", "real", "original"]
HEADLINE = {"human_fpr": ("R1_iid", "fpr"), "ai_fnr": ("R1_iid", "fnr"), "ood_auroc": ("R3_unseen_generator", "auroc"), "adversarial_fnr": ("R5_adversarial", "fnr"), "ece": ("R1_iid", "ece")}
CAPTION_FIELDS = ["scene", "objects", "spatial_relations", "composition", "lighting", "colour_palette", "camera_perspective", "time_of_day"]
MAX_FIELD_CHARS = 400
ADDRESS_OR_RIGHTS = r"(?i)\b(?:https?://|www\.)\S+|\b(?:copyright|\(c\))\b|©"
PROPER_NOUN = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"
SHAPES, FEATHERS, AREA_FRACTIONS = ["rectangle", "ellipse"], [0, 3, 9, 18], [0.08, 0.15, 0.25, 0.4]
MAX_MANIFEST_CHARS = 4096
# ----------------------


def headline(regimes: DataFrame) -> DataFrame:
    """One row of the headline figures, each from the regime that has it; null where that wasn't run. ``regimes``: (name, fpr, fnr, auroc, ece)."""
    return regimes.agg(*(F.max(F.when(F.col("name") == name, F.col(figure))).alias(column) for column, (name, figure) in HEADLINE.items()))


def best_checkpoint(evaluations: DataFrame, run: str, budget: float) -> DataFrame:
    """(run, step, fpr, fnr, in_budget): within the budget the lowest fnr, else the lowest fpr; of equals the earliest. ``evaluations``: (run, step, fpr, fnr)."""
    inside = F.col("fpr") <= budget
    order = F.struct((~inside).alias("out"), F.when(inside, F.col("fnr")).otherwise(F.col("fpr")).alias("value"), "step")
    best = evaluations.groupBy(run).agg(F.min_by(F.struct("step", "fpr", "fnr", inside.alias("in_budget")), order).alias("b"))
    return best.select(run, "b.*")


def evidence(source: Column) -> Column:
    """human, generator or none: what the name of a source says about who wrote it; human markers go first."""
    low = F.regexp_replace(F.lower(source), "[^a-z0-9]+", " ")
    any_of = lambda markers: reduce(lambda a, b: a | b, (low.contains(m) for m in markers))
    return F.when(any_of(HUMAN_MARKERS), "human").when(any_of(GENERATOR_MARKERS), "generator").otherwise("none")


def evidence_crosstab(rows: DataFrame, label: str, source: str) -> DataFrame:
    """(label, human, generator, none, generator_share): rows per label and evidence, and the generators' share of what has evidence."""
    kind = evidence(F.coalesce(F.col(source), F.lit("")))
    per = rows.where(F.col(label).isNotNull()).groupBy(label).agg(*(F.count_if(kind == k).alias(k) for k in ("human", "generator", "none")))
    return per.withColumn("generator_share", F.col("generator") / F.greatest(F.lit(1), F.col("generator") + F.col("human")))


def machine_label(crosstab: DataFrame, label: str, least: float = 0.9) -> DataFrame:
    """(label) that names machine text by the evidence: the only one with more than ``least`` generators, else no row."""
    sure = crosstab.where(F.col("generator_share") > least)
    return sure.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("_n = 1").select(label)  # a row a label


def held_out_leaks(rows: DataFrame, family: str, roster: DataFrame) -> DataFrame:
    """(family, n_rows): families of the roster (family, role) that are held out and yet wrote rows."""
    held = roster.where("role = 'held_out'").select(F.col("family").alias(family))
    return rows.join(F.broadcast(held), family, "left_semi").groupBy(family).agg(F.count("*").alias("n_rows"))  # a roster lists a few generators


def require_no_leaks(leaks: DataFrame, family: str) -> None:
    names = sorted(r[family] for r in leaks.collect())
    if names:
        raise ValueError(f"held-out families wrote training rows: {names}")


# ---- image records: metadata only ----
def manifest_faults(records: DataFrame, key: str) -> DataFrame:
    """(key, fault) of records that can't go into a manifest: repeated, no_split, or a field too large to be metadata."""
    text = [f.name for f in records.schema if f.dataType.simpleString() == "string"]
    large = reduce(lambda a, b: a | b, (F.coalesce(F.length(c) > MAX_MANIFEST_CHARS, F.lit(False)) for c in text))
    per = records.groupBy(key).agg(F.count("*").alias("n"), F.max(large).alias("large"), F.max(F.coalesce(F.col("split"), F.lit("")) == "").alias("unsplit"))
    return per.select(key, F.when(F.col("large"), "oversized_field").when(F.col("n") > 1, "repeated").when(F.col("unsplit"), "no_split").alias("fault")).where("fault is not null")


def manifest_summary(records: DataFrame) -> DataFrame:
    """(kind, value, n): how many images in all, per split and per license."""
    sets = records.groupingSets([[], [F.col("split")], [F.col("license")]], "split", "license").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "images").when(F.col("g") == 1, "split").otherwise("license")
    return sets.select(kind.alias("kind"), F.coalesce("split", "license").alias("value"), "n")


def manifest_lines(records: DataFrame, key: str) -> DataFrame:
    """(line): a JSON object per record, fields and records in order, so that equal corpora give equal files."""
    return records.orderBy(key).select(F.to_json(F.struct(*sorted(records.columns))).alias("line"))


def index_summary(samples: DataFrame) -> DataFrame:
    """(split, label, samples, kinds, groups, with_mask) of an index (sample_id, kind, split, label, group_id, mask_ref)."""
    return samples.groupBy("split", "label").agg(F.count("*").alias("samples"), F.count_distinct("kind").alias("kinds"), F.count_distinct("group_id").alias("groups"), F.count("mask_ref").alias("with_mask"))


def byte_pick(options: list, key: Column, prefix: str) -> Column:
    """The option chosen by the first four bytes of sha-256 of ``prefix:key``."""
    number = hex_number(F.sha2(F.concat(F.lit(prefix + ":"), key), 256), 8)
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def unmatched_pick(options: list, index: Column, field: str) -> Column:
    return byte_pick(options, F.concat(F.lit(f"{field}:"), index.cast("string")), "unmatched-v1")


def composite_geometry(image: Column, width: Column, height: Column) -> dict[str, Column]:
    """shape, feather, area, left, top and side of the region pasted into an image, by digests of its id."""
    key = image.cast("string")
    area = byte_pick(AREA_FRACTIONS, F.concat(F.lit("area:"), key), "composite-v1")
    side = F.least(F.greatest(F.floor(F.sqrt(width * height * area)), F.lit(16)), width - 2, height - 2)
    digest = F.sha2(F.concat(F.lit("composite-v1:pos:"), key), 256)
    place = lambda at, room: F.pmod(hex_number(F.substring(digest, at, 4), 4), F.greatest(room - side, F.lit(1)))
    return {
        "shape": byte_pick(SHAPES, F.concat(F.lit("shape:"), key), "composite-v1"), "feather": byte_pick(FEATHERS, F.concat(F.lit("feather:"), key), "composite-v1"), "area": area,
        "left": place(1, width), "top": place(5, height), "side": side,
    }


def caption_fault(fields: dict[str, Column]) -> Column:
    """empty:<field>, too_long:<field> or identifying:<field> for the first field at fault, in the fields' order; null if none is."""
    out = F.lit(None).cast("string")
    for name in reversed(CAPTION_FIELDS):
        c = fields[name]
        fault = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(F.length(c) > MAX_FIELD_CHARS, "too_long").when(c.rlike(ADDRESS_OR_RIGHTS) | c.rlike(PROPER_NOUN), "identifying")
        out = F.coalesce(F.concat(fault, F.lit(f":{name}")), out)
    return out


def caption_prompt(fields: dict[str, Column]) -> Column:
    """The prompt of a caption, its fields in order."""
    return F.concat(F.concat_ws(". ", *(F.concat(F.lit(re.sub("_", " ", name) + ": "), F.trim(fields[name])) for name in CAPTION_FIELDS)), F.lit("."))
