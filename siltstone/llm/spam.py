"""Problem 10: keyword-stuffed, link-list and tag pages by block-wise compression.

A text is cut into blocks: long lines (in parts of at most BLOCK_CHARS), and runs of short lines between blank lines; what is
shorter than LEAST_CHARS is gathered into blocks of its own, and left unmeasured if that is still too short to compress.
A block is compressed twice: as it stands, which shows repeated words, and coded, which shows repeated forms. Coded
means that common words stay (they carry sentences), every run of other words becomes one sign, digits inside a token become a 9
and all else stays, numbers that stand alone included; words joined by case changes count as several. So a list of links or tags is
as redundant as its marks are, whatever its words, while figures and sentences keep their information.

Both ratios (compressed bytes to bytes of the block as it stands) are divided by the median of punctuated blocks of the
language and length class in the collection; far below that is extreme redundancy, and few sentence ends confirm it (refrains
have many). An end counts if its sentence has at least SENTENCE_COMMON different common words, so that keywords
with full stops between them have none. A page is spam if such blocks hold more than SHARE of its characters.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

BLOCK_CHARS = 1000
SHORT_LINE = 160
LEAST_CHARS = 64
#: Limits of the two relative ratios.
MOST_RATIO, MOST_CODED = 0.72, 0.76
MOST_ENDS = 0.012
SHARE = 0.45
PROSE_ENDS = 0.02
SENTENCE_COMMON = 3
LEAST_BLOCKS = 30
#: zlib's fixed cost in bytes, and the usual ratios of prose by binary logarithm of the length for
#: classes with too few blocks (fixed values).
OVERHEAD = 8
USUAL_RATIO = {6: 0.8, 7: 0.68, 8: 0.61, 9: 0.55, 10: 0.5}
USUAL_CODED = {6: 0.32, 7: 0.28, 8: 0.25, 9: 0.21, 10: 0.19}

ENDS = re.compile(r"""[.!?…]["'”’»)\]]*(?=\s|$)""")
LETTERS = re.compile(r"[^\W\d_]+")
WORD_OR_NOT = re.compile(r"([^\W\d_]+)")
DIGIT = re.compile(r"\d")
CASE_CHANGE = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
INNER_DIGITS = re.compile(r"(?<=[^\s\d.,:])\d+|\d+(?=[^\s\d.,:])")
OTHER_WORDS = re.compile(r"\x01(?: \x01)*")


class Codes(dict):
    """Word -> itself in lower case if it is common, else a sign (several if its case changes inside); filled as words come."""

    def __init__(self, common: frozenset[str], most: int = 400_000):
        super().__init__()
        self.common, self.most = common, most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        parts = CASE_CHANGE.sub(" ", word).lower().split(" ")
        self[word] = code = " ".join(p if p in self.common else "\x01" for p in parts)
        return code


def coded(block: str, codes: Codes) -> tuple[str, int]:
    """The block with common words, numbers and marks as they are, inner digits as 9 and runs of other words as one sign; and how many words it has."""
    parts = WORD_OR_NOT.split(block)
    parts[1::2] = map(codes.__getitem__, parts[1::2])
    out = "".join(parts)
    if DIGIT.search(out):
        out = INNER_DIGITS.sub("9", out)
    return OTHER_WORDS.sub("\x01", out), len(parts) // 2


def blocks(text: str) -> list[str]:
    """The blocks of a text in order, those gathered from short ones last; blank lines are in none."""
    out: list[str] = []
    small: list[str] = []
    run: list[str] = []
    size = 0
    ended = False

    def close(lines: list[str]):
        block = "\n".join(lines)
        (small if len(block) < LEAST_CHARS else out).append(block)

    for raw in text.split("\n"):
        line = raw.strip()
        ends = bool(line) and ENDS.search(line, max(0, len(line) - 4)) is not None
        if run and (not line or len(line) >= SHORT_LINE or size > BLOCK_CHARS or ends != ended):
            close(run)
            run, size = [], 0
        if len(line) >= SHORT_LINE:
            for part in parts(line):
                close([part])
        elif line:
            run.append(line)
            size += len(line)
        ended = ends
    if run:
        close(run)
    gathered: list[str] = []
    for block in small:
        gathered.append(block)
        if sum(map(len, gathered)) > BLOCK_CHARS:
            out.append("\n".join(gathered))
            gathered = []
    return out + ["\n".join(gathered)] if gathered else out


def parts(line: str) -> list[str]:
    """A long line in parts of about equal size, at most BLOCK_CHARS, cut at blanks where there are any."""
    n = -(-len(line) // BLOCK_CHARS)
    size = -(-len(line) // n)
    out, at = [], 0
    while at < len(line):
        end = min(len(line), at + size)
        if end < len(line):
            blank = line.rfind(" ", at + size // 2, end)
            end = blank + 1 if blank >= 0 else end
        out.append(line[at:end])
        at = end
    return out


def sentence_ends(code: str) -> int:
    """Number of sentences of a coded block that end and have enough different common words."""
    n = at = 0
    for end in ENDS.finditer(code):
        n += len(set(LETTERS.findall(code, at, end.start()))) >= SENTENCE_COMMON
        at = end.end()
    return n


def packed(text: str) -> int:
    return max(0, len(zlib.compress(text.encode("utf-8", "replace"), 6)) - OVERHEAD)


def block_measures(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """(doc_id, block_no, lang, chars, size_class, ratio, coded, ends) of each block of ``pages`` (doc_id bigint, lang, text).

    ``ends``: sentence ends per word. Blocks too short to compress have null ratios. Null and blank texts have no blocks.
    """

    def scan(rows):
        codes = Codes(common)
        for batch in rows:
            cols: list[list] = [[] for _ in range(8)]
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, block in enumerate(blocks(text)):
                    size = len(block.encode("utf-8", "replace"))
                    code, n_words = coded(block, codes)
                    both = (packed(block.lower()) / size, packed(code) / size) if len(block) >= LEAST_CHARS else (None, None)
                    row = (doc, k, lang, len(block), int(math.log2(size)), *both, sentence_ends(code) / max(1, n_words))
                    for c, v in zip(cols, row):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "block_no", "lang", "chars", "size_class", "ratio", "coded", "ends"])

    schema = "doc_id long, block_no int, lang string, chars int, size_class int, ratio double, coded double, ends double"
    return pages.where("doc_id is not null and text is not null").select("doc_id", "lang", "text").mapInArrow(scan, schema)


def judged_blocks(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """The blocks with both ``relative`` ratios and ``spam``; ``common``: the common words of all languages, lower case."""
    measured = cut(block_measures(pages, common))
    prose = measured.where((F.col("ends") >= PROSE_ENDS) & F.col("ratio").isNotNull())

    def medians(suffix: str, *by: str) -> DataFrame:
        per = prose.groupBy(*by).agg(*(F.percentile_approx(c, 0.5, 1000).alias(c + suffix) for c in ("ratio", "coded")), F.count("*").alias("n"))
        return F.broadcast(per.where(F.col("n") >= LEAST_BLOCKS).drop("n"))

    own = medians("_own", "lang", "size_class").select(F.coalesce("lang", F.lit("")).alias("l"), "size_class", "ratio_own", "coded_own")
    both = measured.withColumn("l", F.coalesce("lang", F.lit(""))).join(F.broadcast(own), ["l", "size_class"], "left").join(medians("_every", "size_class"), "size_class", "left").drop("l")

    def relative(c: str, usual: dict[int, float]):
        least, most = min(usual), max(usual)
        fixed = F.element_at(F.create_map(*(F.lit(x) for kv in usual.items() for x in kv)), F.least(F.greatest("size_class", F.lit(least)), F.lit(most)))
        return F.col(c) / F.coalesce(f"{c}_own", f"{c}_every", fixed)

    both = both.withColumn("relative", relative("ratio", USUAL_RATIO)).withColumn("relative_coded", relative("coded", USUAL_CODED))
    redundant = (F.col("relative") < MOST_RATIO) | (F.col("relative_coded") < MOST_CODED)
    return both.withColumn("spam", F.coalesce(redundant & (F.col("ends") < MOST_ENDS), F.lit(False))).drop("ratio_own", "coded_own", "ratio_every", "coded_every")


def judged_pages(pages: DataFrame, common: frozenset[str]) -> DataFrame:
    """(doc_id, n_blocks, n_spam_blocks, spam_share, lowest, lowest_coded, is_spam) of each page with text; equal ids count together."""
    per = judged_blocks(pages, common).groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"), F.count_if("spam").alias("n_spam_blocks"), (F.sum(F.when(F.col("spam"), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("spam_share"),
        F.min("relative").alias("lowest"), F.min("relative_coded").alias("lowest_coded"),
    )
    return per.withColumn("is_spam", F.col("spam_share") > SHARE)
