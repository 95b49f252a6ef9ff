"""Raw records to a clean, deduplicated, split corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions.plain import detected_language, length_fault, reject_fault
from siltstone.functions.python_udfs import normalize_text, redact_text
from siltstone.operators import dedup, gates
from siltstone.runtime import cut, spread

FREE_LICENSES = ["odc-by", "public-domain", "cc0", "cc-by"]
JUDGED = "clean string, language string, language_score double, detector string, pii_flags string, token_count int, reject_reason string"


def judged_records(raw: DataFrame, policy: gates.CleaningPolicy = gates.CleaningPolicy(), kept_only: bool = False) -> DataFrame:
    """Every record with its text as it would be written (``text``), language, kinds of personal data and first ``reject_reason``.

    In the order schema, normalise, length, language, quality, redaction, length: one pass over the texts, each held in Python once. Rejected records
    keep their normalised, not redacted text; with ``kept_only`` they are left out in the pass.
    """
    names = [f.split(" ")[0] for f in JUDGED.split(", ")]
    types = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def judge(record, text, upstream, upstream_score):
        text = None if text is None else normalize_text(text)
        low = (text or "").lower()
        language, score, detector = detected_language(low, upstream, upstream_score)
        reason, kinds = reject_fault(record, text, low, language, score, policy), []
        if reason is None:
            text, kinds = redact_text(text)
            late = length_fault(text, policy.length)
            reason = late and f"{late}_after_redaction"
        return text, language, score, detector, ",".join(kinds), len(text.split()) if text is not None else None, reason

    def scan(rows):
        for batch in rows:
            place = {name: i for i, name in enumerate(batch.schema.names)}
            done = [judge(*x) for x in zip(*(batch.column(place[c]).to_pylist() for c in ("source_record_id", "text", "up_lang", "up_score")))]
            at = pa.array([i for i, x in enumerate(done) if not kept_only or x[-1] is None], pa.int64())
            cols = list(zip(*(done[i] for i in at.to_pylist()))) or [()] * len(types)
            rest = [batch.column(i).take(at) for name, i in place.items() if name not in ("text", "up_lang", "up_score")]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(c, t) for c, t in zip(cols, types)], [n for n in place if n not in ("text", "up_lang", "up_score")] + names)

    rows = raw.select("source_record_id", "source_id", "source_config", "license", "domain", "register", "acquired_at", "text", F.col("upstream_language.lang").alias("up_lang"), F.col("upstream_language.score").alias("up_score"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "up_lang", "up_score"))
    return rows.mapInArrow(scan, f"{kept}, {JUDGED}").withColumnRenamed("clean", "text")


def clean(raw: DataFrame, policy: gates.CleaningPolicy = gates.CleaningPolicy(), near: bool = True) -> DataFrame:
    """Kept records as documents: doc_id, source, text, hash, split; exact and near duplicates resolved to the least id.

    Duplicates are resolved on ids, hashes and signatures; texts are written once and joined with the rows that stay.
    """
    kept = judged_records(spread(raw), policy, kept_only=True)
    docs = cut(
        kept.select(
            F.concat_ws("_", "source_id", "source_record_id").alias("doc_id"), F.coalesce("source_id", F.lit("unknown")).alias("source"), "source_config", "text", "license", "domain", "register", "language", "language_score", "detector", "acquired_at",
            F.sha2("text", 256).alias("content_sha256"), "token_count", "pii_flags", F.coalesce(F.col("license").isin(FREE_LICENSES), F.lit(False)).alias("redistributable"), F.monotonically_increasing_id().alias("row"),
        )
    )
    first = docs.groupBy("content_sha256").agg(F.min(F.struct("doc_id", "row")).alias("k")).select("k.*")
    staying = cut(first.groupBy("doc_id").agg(F.min("row").alias("row")))
    docs = docs.join(staying.select("row"), "row", "left_semi")
    if near:
        settled = dedup.first_wins(staying.select(F.col("doc_id").alias("id")), dedup.banded_pairs(dedup.signatures(spread(docs.select("doc_id", "text")), "doc_id", "text")))
        docs = docs.join(settled.where("duplicate_of is null").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    group = H.group_id(F.col("doc_id"))
    return docs.drop("row").withColumn("source_group_id", group).withColumn("split", H.split_of_group(group))
