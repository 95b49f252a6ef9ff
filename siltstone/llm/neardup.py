"""Problem 4: near-duplicate records by DartMinHash signatures and a banded join.

A text is the set of its distinct three-word runs (``shingle`` words in general), each of weight 1
(``weighted`` takes the number of occurrences). Texts with the same words are one *class*, which is
signed once per scan task and compared once. Signatures of ``bands * rows`` coordinates are cut into
bands; classes that agree in a band are candidates, checked exactly on their words.

Recall. With 50 bands of 5 rows two texts of similarity 0.6 meet with probability 0.982, of 0.65
with 0.998 and of 0.7 with 0.9999; unrelated texts (below 0.1) with less than 0.0005.

Scale. Band rows are two longs and a count. Keys with many classes (found on a fixed 1/32 sample of
the classes; the sample decides about balance only, never about results) are split into blocks,
and pairs of blocks spread over tasks. Texts are fetched only for classes that have a candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import bloom
from siltstone.llm.dartminhash import band_keys, signatures
from siltstone.llm.textwork import WordHashes, batches, first_of_each, run_fingerprints, words
from siltstone.runtime import cut, shuffle_width

BANDS, ROWS = 50, 5
LEAST_WORDS = 20
SAMPLE_ONE_IN = 32
BLOCK = 8_000
ROWS_PER_TASK = 1_500_000
PAIRS_PER_BATCH = 500_000


def class_id(tokens: list[str]) -> int:
    """64-bit id of a word sequence."""
    return xxhash.xxh3_64_intdigest(" ".join(tokens)) - (1 << 63)


def signed(docs: DataFrame, shingle: int = 3, least_words: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(id, cls, n, keys) of each text with ``least_words`` words: its class, number of distinct runs and band keys.

    A class already signed by the same task has null keys. Null ids and texts give nothing.
    """

    def scan(batches_in):
        hashes, seen = WordHashes(), set()
        for batch in batches_in:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts, 1_000_000):
                at, classes, fresh, tokens, lengths = [], [], [], [], []
                for i in range(a, b):
                    own = words(texts[i])
                    if len(own) < least_words:
                        continue
                    cls = class_id(own)
                    at.append(i)
                    classes.append(cls)
                    fresh.append(cls not in seen)
                    if fresh[-1]:
                        if len(seen) > 2_000_000:
                            seen.clear()
                        seen.add(cls)
                        tokens += own
                        lengths.append(len(own))
                if not at:
                    continue
                n, keys = np.zeros(0, int), np.zeros((0, bands), np.uint64)
                if lengths:
                    runs, owner, _ = run_fingerprints(hashes.of(tokens), np.array(lengths), shingle)
                    first = first_of_each(owner, runs)
                    weights = _occurrences(owner, runs)[first].astype(float) if weighted else None
                    n = np.bincount(owner[first], minlength=len(lengths))
                    keys = band_keys(signatures(runs[first], owner[first], len(lengths), bands * rows, weights), bands, rows)
                where = np.where(fresh, np.cumsum(fresh) - 1, -1)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.array(fresh, dtype=np.int32) * bands))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel(), pa.int64()))
                sizes = pa.array([int(n[w]) if w >= 0 else None for w in where], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(classes, pa.int64()), sizes, lists], ["id", "cls", "n", "keys"])

    return docs.where("id is not null and text is not null").select("id", "text").mapInArrow(scan, "id string, cls long, n int, keys array<long>")


def _occurrences(owner: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """How often each (owner, run) occurs, at each of its places."""
    order = np.lexsort((runs, owner))
    o, r = owner[order], runs[order]
    starts = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (r[1:] != r[:-1])))) if len(o) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(o)))
    out = np.empty(len(o), dtype=np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _pairs_within(least: float):
    """Pairs of classes with one key; the rows of a partition come sorted by (key, cls)."""

    def emit(key, cls, n, block, mixed):
        order = np.lexsort((cls, key))
        key, cls, n, block, mixed = key[order], cls[order], n[order], block[order], mixed[order]
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, n, block, mixed = key[keep], cls[keep], n[keep], block[keep], mixed[keep]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        partners = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1  # later rows of the same key
        ends = np.cumsum(partners)
        total, at = int(ends[-1]) if len(ends) else 0, 0
        while at < total:
            flat = np.arange(at, min(at + PAIRS_PER_BATCH, total))
            i = np.searchsorted(ends, flat, "right")
            j = i + 1 + flat - (ends[i] - partners[i])
            ok = (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])) & ((block[i] != block[j]) | ~mixed[i])
            yield pa.RecordBatch.from_arrays([pa.array(cls[i[ok]]), pa.array(cls[j[ok]])], ["a", "b"])
            at += PAIRS_PER_BATCH

    def stream(batches_in):
        held = None  # columns that may continue in the next batch
        for batch in batches_in:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key = cols[0]
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if last:
                yield from emit(*[c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield from emit(*held)

    return stream


def candidates(sig: DataFrame, least: float, bands: int = BANDS) -> DataFrame:
    """(a, b) classes, a < b, that agree in a band and whose numbers of runs allow the similarity ``least``."""
    spark = sig.sparkSession
    rows = sig.where("keys is not null").select("cls", "n", F.explode("keys").alias("key"))
    sample = rows.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE_ONE_IN)) == 0)
    hot = sample.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") * SAMPLE_ONE_IN > 2 * BLOCK)
    hot = cut(hot.select("key", F.ceil(F.col("c") * SAMPLE_ONE_IN / BLOCK).cast("int").alias("blocks")))
    n_rows = sig.count() * bands
    if hot.isEmpty():
        cells = rows.select("key", "cls", "n", F.lit(0).alias("block"), F.lit(False).alias("mixed"))
    else:
        g = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks").cast("long")).cast("int")
        spread = rows.join(hot, "key").withColumn("block", g).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "cls", "n", "block", (F.col("block") != F.col("other")).alias("mixed"))
        cold = rows.join(hot, "key", "left_anti").select("key", "cls", "n", F.lit(0).alias("block"), F.lit(False).alias("mixed"))
        cells = cold.unionByName(spread)
    width = shuffle_width(spark, n_rows, ROWS_PER_TASK)
    met = cells.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_pairs_within(least), "a long, b long")
    return met.distinct()


def _checked(shingle: int, least: float):
    def runs(text, cache):
        own = cache.get(text)
        if own is None:
            if len(cache) > 2000:
                cache.clear()
            w = text.split(" ")
            own = cache[text] = frozenset(zip(*(w[k:] for k in range(shingle))))
        return own

    def scan(batches_in):
        cache = {}
        for batch in batches_in:
            a, b, wa, wb = (c.to_pylist() for c in batch.columns)
            out = []
            for x, y, u, v in zip(a, b, wa, wb):
                u, v = runs(u, cache), runs(v, cache)
                common = len(u & v)
                similarity = common / (len(u) + len(v) - common)
                if similarity >= least:
                    out.append((x, y, similarity))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "similarity"])

    return scan


def _wanted(known):
    """The (id, text) rows whose id the filter has, as (id, joined words)."""

    def scan(batches_in):
        for batch in batches_in:
            ids = batch.column(0).to_pylist()
            keys = np.fromiter((xxhash.xxh3_64_intdigest(i) for i in ids), np.uint64, len(ids))
            at = np.flatnonzero(bloom.might_have(known, keys))
            part = batch.take(pa.array(at))
            joined = [" ".join(words(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(joined, pa.string())], ["id", "words"])

    return scan


def _id_keys(batches_in):
    for batch in batches_in:
        ids = batch.column(0).to_pylist()
        keys = np.fromiter((xxhash.xxh3_64_intdigest(i) for i in ids), np.uint64, len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def texts_of(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, words) of the wanted classes (cls), each read from the member of smallest id."""
    chosen = cut(members.groupBy("cls").agg(F.min("id").alias("id")).join(classes, "cls", "left_semi"))
    known = bloom.build(chosen.select("id").mapInArrow(_id_keys, "key long"), chosen.count())
    found = docs.where("id is not null and text is not null").select("id", "text").mapInArrow(_wanted(known), "id string, words string")
    return cut(chosen.join(found, "id").select("cls", "words").dropDuplicates(["cls"]))


def similar_classes(docs: DataFrame, sig: DataFrame, least: float, shingle: int = 3, bands: int = BANDS) -> DataFrame:
    """(a, b, similarity): pairs of different classes at ``least`` or more, checked on their words."""
    pairs = cut(candidates(sig, least, bands))
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = texts_of(docs, sig.select("id", "cls"), needed)
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("words").alias("words_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("words").alias("words_b")), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(_checked(shingle, least), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, least: float = 0.8, shingle: int = 5, least_words: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cls) and similar classes (a, b, similarity) of ``docs`` (id string, text).

    Rows repeated under one id count once; empty input gives two empty frames.
    """
    sig = cut(signed(docs, shingle, least_words, bands, rows, weighted))
    return sig.select("id", "cls").distinct(), similar_classes(docs, sig, least, shingle, bands)


def as_record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller id first: all pairs of different ids in similar classes or in one class."""
    m = cut(members)
    left, right = m.select(F.col("cls").alias("a"), F.col("id").alias("id_1")), m.select(F.col("cls").alias("b"), F.col("id").alias("id_2"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("id_1", "id_2")
    several = m.groupBy("cls").count().where("count > 1").select("cls")
    twins = m.join(several, "cls", "left_semi")
    within = twins.select("cls", F.col("id").alias("id_1")).join(twins.select("cls", F.col("id").alias("id_2")), "cls").where("id_1 < id_2").select("id_1", "id_2")
    return across.unionByName(within).where("id_1 <> id_2").select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def links_per_record(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cls, n_copies, n_links): a record's class, its other members, and how many classes are similar to it."""
    both = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    links = both.groupBy("cls").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("cls").agg((F.count("*") - 1).alias("n_copies"))
    return members.join(copies.join(links, "cls", "left"), "cls").select("id", "cls", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
