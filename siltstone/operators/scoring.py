"""Windowed examples, document scores and scans with an injected scorer.

A scorer is made once per Python worker by ``make`` and called with the list of a document's windows (texts); it gives
one score each. Documents are scored in Arrow batches where they lie; only scores leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.spans import IGNORE, WORD_RUN, window_bounds, windows

Scorer = Callable[[Sequence[str]], Sequence[float]]
_MADE: dict[str, Scorer] = {}
SCORED = "doc_id string, score_mean double, score_max double, n_windows int, failed boolean"


def windowed_examples(labelled: DataFrame, size: int = 512, stride: int = 384, least: float = 0.5) -> DataFrame:
    """(doc_id, window, token_start, token_end, char_start, char_end, fraction, label) of each window of each document.

    ``labelled``: (doc_id, offsets array of (start, end), labels array of label ids). ``fraction`` is the share of the window's
    labelled tokens that aren't human, 0 without any; the window's label follows from its own fraction. The characters are those from the
    first token that isn't empty to the last. Documents without tokens have no windows.
    """
    w = F.col("w")
    part = lambda c: F.slice(c, w["start"] + 1, w["end"] - w["start"])
    real = F.filter(part("labels"), lambda x: x != IGNORE)
    solid = F.filter(part("offsets"), lambda o: o["end"] > o["start"])
    each = labelled.select("doc_id", "offsets", "labels", F.posexplode(windows(F.size("offsets"), size, stride)).alias("window", "w"))
    shares = each.select("doc_id", "window", "w", real.alias("real"), solid.alias("solid"))
    marked = F.size(F.filter("real", lambda x: x != 0))
    fraction = F.when(F.size("real") > 0, marked / F.size("real")).otherwise(0.0)
    start = F.coalesce(F.try_element_at("solid", F.lit(1))["start"], F.lit(0))
    return shares.select(
        "doc_id", "window", w["start"].alias("token_start"), w["end"].alias("token_end"), start.alias("char_start"), F.coalesce(F.try_element_at("solid", F.lit(-1))["end"], start).alias("char_end"), fraction.alias("fraction"), (fraction >= least).cast("int").alias("label")
    )


def text_windows(text: str, size: int, stride: int) -> list[str]:
    """The texts of a document's token windows; a token is a run of letters and digits."""
    places = [m.span() for m in WORD_RUN.finditer(text)]
    return [text[places[a][0] : places[b - 1][1]] for a, b in window_bounds(len(places), size, stride)]


def scored_documents(docs: DataFrame, name: str, make: Callable[[], Scorer], size: int = 510, stride: int = 384) -> DataFrame:
    """(doc_id, score_mean, score_max, n_windows, failed) of each document (doc_id, text) with a token.

    ``name`` tells scorers apart in a worker, which makes each once. A document whose scoring raises is ``failed`` with null scores and
    takes no other with it. Null texts and texts without tokens have no row.
    """

    def scan(rows):
        scorer = _MADE.get(name) or _MADE.setdefault(name, make())
        for batch in rows:
            out: list[tuple] = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = text_windows(text, size, stride)
                if not parts:
                    continue
                try:
                    scores = [float(x) for x in scorer(parts)]
                    out.append((doc, sum(scores) / len(scores), max(scores), len(scores), False))
                except Exception:  # noqa: BLE001 - whatever an injected scorer may raise; counted as failed
                    out.append((doc, None, None, len(parts), True))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split(" ")[0] for f in SCORED.split(", ")])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(scan, SCORED)


def scan_hits(scored: DataFrame, threshold: float) -> DataFrame:
    """The documents at the threshold or above; all a scan sends on."""
    return scored.where(F.col("score_mean") >= threshold).drop("failed")


def scan_totals(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: documents scanned, failed, and at the threshold or above, summed where they were scanned."""
    return scored.agg(F.count("*").alias("scanned"), F.count_if("failed").alias("errors"), F.count_if(F.col("score_mean") >= threshold).alias("above_threshold"))


def should_flush(requests: DataFrame, queue: str, n: Column, age_ms: Column, most: int, wait_ms: int) -> DataFrame:
    """(queue, total, oldest_ms, flush): a queue is due when it is full or its oldest request has waited long enough."""
    per = requests.groupBy(queue).agg(F.sum(n).alias("total"), F.max(age_ms).alias("oldest_ms"))
    return per.withColumn("flush", (F.col("total") >= most) | (F.col("oldest_ms") >= wait_ms))
