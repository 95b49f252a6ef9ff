"""Mixed documents with known spans, generation loops with an injected model, and batch packing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ASSISTANT_OPENING
from siltstone.operators.dedup import minhash_rows, shingle_values

BLANK_LINE = re.compile(r"\n\s*\n")
PREAMBLE = re.compile(ASSISTANT_OPENING)
LEAST_PARAGRAPH, LEAST_EQUAL_RUN = 80, 24
FRACTION = (0.05, 0.95)
SPANS = "array<struct<start_char:int,end_char:int,label:string>>"
SPAN_TYPE = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("label", pa.string())]))


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, BLANK_LINE.split(text)) if len(p) >= LEAST_PARAGRAPH]


def join_touching(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, label in sorted(spans):
        if out and out[-1][1] == a and out[-1][2] == label:
            a = out.pop()[0]
        out.append((a, b, label))
    return out


def splice(human: str, other: str, key: str, label: str = "ai_generated") -> tuple[str | None, list, str | None]:
    """(text, spans, reason): paragraphs of both interleaved by the bits of the key's digest, in order on either side.

    A side that has run out leaves its turn to the other. No text, but a reason, if a side has fewer than two paragraphs.
    """
    left, right = paragraphs(human), paragraphs(other)
    if len(left) < 2 or len(right) < 2:
        return None, [], "human_too_few_paragraphs" if len(left) < 2 else "ai_too_few_paragraphs"
    total = len(left) + len(right)
    bits = int(hashlib.sha256(key.encode()).hexdigest(), 16)
    turns = [bool(bits >> i & 1) for i in range(total)]
    if not any(turns):
        turns[total // 2] = True
    if all(turns):
        turns[0] = False
    queues = {False: iter(left), True: iter(right)}
    left_over = {False: len(left), True: len(right)}
    text, spans = "", []
    for k, turn in enumerate(turns):
        side = turn if left_over[turn] else not turn
        left_over[side] -= 1
        chunk = next(queues[side]) + ("\n\n" if k < total - 1 else "")
        spans.append((len(text), len(text) + len(chunk), label if side else "human"))
        text += chunk
    return text, join_touching(spans), None


def edit_spans(original: str, edited: str, label: str = "ai_assisted") -> list[tuple[int, int, str]]:
    """Spans of the edited text by a word-level comparison; short equal runs between two edits count as edited."""
    words = lambda t: [m.span() for m in re.finditer(r"^\s+|\S+\s*", t)]
    new = words(edited)
    matcher = SequenceMatcher(None, [original[a:b] for a, b in words(original)], [edited[a:b] for a, b in new], autojunk=False)
    spans = [[new[j1][0], new[j2 - 1][1], "human" if tag == "equal" else label] for tag, _, _, j1, j2 in matcher.get_opcodes() if j2 > j1]
    for before, own, after in zip(spans, spans[1:], spans[2:]):
        if own[2] == "human" and own[1] - own[0] < LEAST_EQUAL_RUN and before[2] == after[2] == label:
            own[2] = label
    return join_touching([tuple(s) for s in spans])


def _as_structs(spans):
    return [{"start_char": a, "end_char": b, "label": x} for a, b, x in spans]


def spliced(pairs: DataFrame, label: str = "ai_generated", construction: str = "splice") -> DataFrame:
    """(doc_id, text, spans, reason) of ``pairs`` (human_id, human_text, other_id, other_text); ``label`` human makes the control."""

    def scan(rows):
        for batch in rows:
            ids, texts, spans, reasons = [], [], [], []
            for hid, human, oid, other in zip(*(c.to_pylist() for c in batch.columns)):
                text, s, reason = splice(human or "", other or "", f"{hid}|{oid}", label)
                ids.append(f"mix_{construction}_{hid}")
                texts.append(text)
                spans.append(_as_structs(s) if text is not None else None)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.string()), pa.array(spans, SPAN_TYPE), pa.array(reasons, pa.string())], ["doc_id", "text", "spans", "reason"])

    return pairs.select("human_id", "human_text", "other_id", "other_text").mapInArrow(scan, f"doc_id string, text string, spans {SPANS}, reason string")


def edited(pairs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, fraction, kept) of ``pairs`` (human_id, human_text, edited_text); kept if 5 to 95 % of the characters changed."""

    def scan(rows):
        for batch in rows:
            cols: list[list] = [[] for _ in range(5)]
            for hid, human, new in zip(*(c.to_pylist() for c in batch.columns)):
                spans = edit_spans(human or "", new or "") if new else []
                share = sum(b - a for a, b, x in spans if x != "human") / len(new) if new else 0.0
                kept = bool(new) and new.strip() != (human or "").strip() and FRACTION[0] <= share <= FRACTION[1]
                for c, v in zip(cols, (f"mix_edit_{hid}", new, _as_structs(spans), share, kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), SPAN_TYPE, pa.float64(), pa.bool_()))], ["doc_id", "text", "spans", "fraction", "kept"])

    return pairs.select("human_id", "human_text", "edited_text").mapInArrow(scan, f"doc_id string, text string, spans {SPANS}, fraction double, kept boolean")


def pretend(prompt: str, target_words: int, seed: int) -> str:
    """Offline stand-in for a model: a deterministic text of about the target length in three to five paragraphs."""
    h = int(hashlib.sha256(f"{prompt}|{seed}".encode()).hexdigest(), 16)
    n = max(int(target_words * (0.85 + (h % 30) / 100)), 20)
    pool = (re.findall(r"[a-z]{3,}", prompt.lower()) or ["text"]) + ["the", "of", "and", "with", "near", "under"]
    words = [pool[(h >> (i % 200)) * (i + 1) % len(pool)] for i in range(n)]
    size = -(-n // (3 + h % 3))
    return "\n\n".join(" ".join(words[i : i + size]).capitalize() + "." for i in range(0, n, size))


def fault_of(text: str, target: int, source: str | None = None, ratio: tuple[float, float] = (0.6, 1.6), least: float = 0.5) -> str | None:
    """The first fault of a generated text (stripped), null if it has none.

    In order: empty, assistant_preamble, too_short or too_long in words against the target, near_duplicate_of_source by estimated similarity.
    """
    share = len(text.split()) / max(target, 1)
    faults = {
        "empty": lambda: not text,
        "assistant_preamble": lambda: PREAMBLE.match(text) is not None,
        "too_short": lambda: share < ratio[0],
        "too_long": lambda: share > ratio[1],
        "near_duplicate_of_source": lambda: source is not None and (minhash_rows(shingle_values(text)) == minhash_rows(shingle_values(source))).mean() > least,
    }
    return next((name for name, holds in faults.items() if holds()), None)


def generated(specs: DataFrame, model: Callable[[str, int, int], str], retries: int = 2, ratio: tuple[float, float] = (0.6, 1.6)) -> DataFrame:
    """(doc_id, family, attempt, reason, text): each spec generated until it validates, at most ``retries`` more times with the next seed.

    ``specs``: (doc_id, family, prompt, target_words, seed) and, where counterparts must differ from it, source (a text). Rows come by family within a task, so that a worker changes models seldom. The last
    attempt's reason stays (see ``fault_of``), its text doesn't.
    """

    def scan(rows):
        for batch in rows:
            cols: list[list] = [[] for _ in range(5)]
            for doc, family, prompt, target, seed, source in zip(*(c.to_pylist() for c in batch.columns)):
                for attempt in range(retries + 1):
                    text = model(prompt, target, seed + attempt).strip()
                    reason = fault_of(text, target, source, ratio)
                    if reason is None:
                        break
                for c, v in zip(cols, (doc, family, attempt, reason, None if reason else text)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "family", "attempt", "reason", "text"])

    width = specs.sparkSession.sparkContext.defaultParallelism
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(width))  # a family's rows fill as many tasks as there are cores
    source = F.col("source") if "source" in specs.columns else F.lit(None).cast("string").alias("source")
    specs = specs.select("doc_id", "family", "prompt", "target_words", "seed", source).repartition(width, "family", salt).sortWithinPartitions("family")
    return specs.mapInArrow(scan, "doc_id string, family string, attempt int, reason string, text string")


MOST_QUEUED = 1_000


def packed_batches(queue: DataFrame, key: str, most: int = 32, most_queued: int | None = None) -> DataFrame:
    """(key, pos, n, batch): first-in-first-out batches by window count within each queue ``key``; oversize requests alone.

    ``queue``: (key, pos, n). A queue's requests pass through its task in order; only the open batch's fill is held. A queue of more than ``most_queued`` requests (a server's limit is MOST_QUEUED) is an error.
    """
    kind = dict(queue.dtypes)[key]

    def scan(rows):
        now, number, fill, queued = None, 0, 0, 0
        for batch in rows:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != now:
                    now, number, fill, queued = k, 0, 0, 0
                queued += 1
                if most_queued is not None and queued > most_queued:
                    raise OverflowError(f"queue {k} holds more than {most_queued} requests")
                if fill and fill + n > most:
                    number, fill = number + 1, 0
                out.append(number)
                number, fill = (number + 1, 0) if n > most else (number, fill + n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "batch"])

    rows = queue.where(F.col(key).isNotNull()).select(key, F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"))
    return rows.repartition(key).sortWithinPartitions(key, "pos", "n").mapInArrow(scan, f"{key} {kind}, pos bigint, n bigint, batch int")
