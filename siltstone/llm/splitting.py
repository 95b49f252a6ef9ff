"""Problem 3: texts over a size limit in pieces, cut where the topic changes, with overlap.

Lexical cohesion: at every sentence end in a size window the words of the block before and of the block after are
compared (cosine of their counts); the depth of the valley a boundary lies in says how much the topic changes
there. The deepest valley in the window, from half the limit to the limit, is the cut; paragraph ends (a blank line, with or
without a sentence end before it) count as deeper.
Without a sentence end it is the last line end, else the last blank, else the limit itself (never between a
letter and its combining mark or inside CRLF, where that can be helped). The next piece starts ``overlap``
code points before the cut.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 40
PARAGRAPH_BONUS = 0.25
CHUNK = 512

WORD = re.compile(r"[^\W_]{4,}")
BOUNDARY = re.compile(r"""\n[^\S\n]*\n\s*|[.!?…]["'”’»)\]]*\s+""")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
BLANK = re.compile(r"\s+")


def cohesion(word_ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosine of the word counts of the BLOCK_WORDS words before and after each position ``at`` (in words)."""
    out = np.zeros(len(at))
    padded = np.concatenate((-np.arange(1, BLOCK_WORDS + 1), word_ids, -np.arange(BLOCK_WORDS + 1, 2 * BLOCK_WORDS + 1)))
    for i in range(0, len(at), CHUNK):
        before = padded[at[i : i + CHUNK, None] + np.arange(BLOCK_WORDS)]
        after = padded[at[i : i + CHUNK, None] + np.arange(BLOCK_WORDS, 2 * BLOCK_WORDS)]
        both = (before[:, :, None] == after[:, None, :]).sum((1, 2))
        own = (before[:, :, None] == before[:, None, :]).sum((1, 2)) * (after[:, :, None] == after[:, None, :]).sum((1, 2))
        out[i : i + CHUNK] = both / np.sqrt(own)
    return out


def depths(similarity: np.ndarray) -> np.ndarray:
    """Depth of each point of a curve below the peaks to its left and right."""
    n = len(similarity)
    left, right = similarity.copy(), similarity.copy()
    for i in range(1, n):
        if left[i - 1] >= similarity[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if right[i + 1] >= similarity[i]:
            right[i] = right[i + 1]
    return left + right - 2 * similarity


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces of a text; one piece if it is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    if limit < 1:
        raise ValueError("max_chars must be at least 1")
    overlap = max(0, overlap)
    if overlap >= limit:
        raise ValueError("the overlap must be below max_chars")
    found = [(m.end(), BLANK_LINE.search(m.group()) is not None) for m in BOUNDARY.finditer(text)]
    ends = np.array([e for e, _ in found], dtype=np.int64)
    paragraph = np.array([p for _, p in found], dtype=bool)
    if len(ends):
        ids: dict[str, int] = {}
        starts, numbers = [], []
        for m in WORD.finditer(text.lower() if len(text.lower()) == n else text):
            starts.append(m.start())
            numbers.append(ids.setdefault(m.group(), len(ids)))
        at = np.searchsorted(np.array(starts, dtype=np.int64), ends)
        depth = depths(cohesion(np.array(numbers, dtype=np.int64), at)) + paragraph * PARAGRAPH_BONUS
    out, start = [], 0
    while n - start > limit:
        low, high = start + max(overlap, limit // 2) + 1, start + limit
        a, b = np.searchsorted(ends, low, "left"), np.searchsorted(ends, high, "right")
        if b > a:
            best = int(a + depth[a:b].argmax())
            end, kind = int(ends[best]), "paragraph" if paragraph[best] else "sentence"
        else:
            line = text.rfind("\n", low - 1, high)
            blanks = list(BLANK.finditer(text, low - 1, high)) if line < 0 else []
            if line >= 0:
                end, kind = line + 1, "line"
            elif blanks:
                end, kind = blanks[-1].end(), "blank"
            else:
                end, kind = high, "hard"
                while end > low and (unicodedata.combining(text[end]) or text[end - 1 : end + 1] == "\r\n"):
                    end -= 1
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def clipped(spans: list | None, start: int, end: int, n: int) -> list | None:
    """The spans' parts in a piece, from its start; overrunning ends are cut off, empty parts dropped."""
    if spans is None:
        return None
    out = []
    for s in spans:
        if s is None or s["start_char"] is None or s["end_char"] is None:
            continue
        a, b = max(s["start_char"], start, 0), min(s["end_char"], end, n)
        if a < b:
            out.append({"start_char": a - start, "end_char": b - start, "label": s["label"]})
    return out


def pieces(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, piece_no, n_pieces, start_char, end_char, cut, text, spans) of the texts over their domain's limit.

    ``docs``: (doc_id string, domain, text, spans); ``limits``: (domain, max_chars, overlap_chars), a small fixed table
    whose row ``unknown`` is for a null domain and for domains it doesn't have. Null ids and null or blank texts are
    left out, rows repeated under one id count once. A limit below 1 or an overlap that isn't below its limit is an error.
    """
    known = {r["domain"]: (r["max_chars"], r["overlap_chars"] or 0) for r in limits.where("domain is not null and max_chars is not null").collect()}
    if any(most < 1 or over >= most for most, over in known.values()):
        raise ValueError("every max_chars must be at least 1 and above its overlap_chars")
    own = F.lit(known.get("unknown", (None, 0))[0])
    for domain, (most, _) in known.items():
        own = F.when(F.col("domain") == domain, most).otherwise(own)
    schema = "doc_id string, piece_no int, n_pieces int, start_char int, end_char int, cut string, text string, spans array<struct<start_char:int,end_char:int,label:string>>"
    span_type = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("label", pa.string())]))
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), span_type]

    def scan(rows):
        for batch in rows:
            cols: list[list] = [[] for _ in types]
            for doc, domain, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                most, overlap = known.get(domain) or known["unknown"]
                cuts = cut_points(text, most, overlap)
                for k, (a, b, kind) in enumerate(cuts):
                    for c, v in zip(cols, (doc, k, len(cuts), a, b, kind, text[a:b], clipped(spans, a, b, len(text)))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split(" ")[0] for f in schema.split(", ")])

    over = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > own)).select("doc_id", "domain", "text", "spans")
    return over.mapInArrow(scan, schema).dropDuplicates(["doc_id", "piece_no"])
