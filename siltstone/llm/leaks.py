"""Problem 1: passages of held-out items inside training records, by sharded suffix arrays.

A suffix stands for a text from one word on, and is ordered by its words: by its first ``run`` words, then by those that follow.
The suffix array of the training records is sharded by the leading words (a hash of the first ``run``, so that all
suffixes a test suffix can match stand in one shard); a shard sorts its suffixes by words and every test suffix is
binary-searched there, words against words. The suffixes it meets have ``run`` words in common with it at
least; as each suffix of either text is searched, the hits of a longer match follow one another on one diagonal (same
distance between the two places), and merge to the longest verbatim match with its place in both texts.

Scale. Only suffixes that can match are built: a Bloom filter of the test suffixes' hashes, of bounded size, is held against
each training suffix during the scan, then one of the training suffixes left against each test suffix. A
filter that is too small for its keys lets more through, never less. Shards over ``ROWS_PER_SHARD`` suffixes are
salted by record, with the test suffixes of that shard in each part, so a passage found in a third of all records spreads
over tasks. Hits leave a shard in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import bloom
from siltstone.llm.textwork import WordHashes, batches, first_of_each, run_fingerprints, words
from siltstone.runtime import cut, shuffle_width

RUN = 24
ROWS_PER_SHARD = 200_000
HITS_PER_BLOCK = 500_000
SHARD_BITS = 12


def _suffix_hashes(hashes: WordHashes, texts: list[str], run: int):
    """(words of all texts, start of each text among them, hash of the first ``run`` words, text, place) of each suffix of ``run`` words or more."""
    tokens, lengths = [], []
    for text in texts:
        own = words(text)
        tokens += own
        lengths.append(len(own))
    lengths = np.array(lengths, dtype=np.int64)
    return tokens, np.cumsum(lengths) - lengths, *run_fingerprints(hashes.of(tokens), lengths, run)


def suffix_keys(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(key): the hash of the leading words of every suffix of ``docs`` (text)."""

    def scan(rows):
        hashes = WordHashes()
        for batch in rows:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                yield pa.RecordBatch.from_arrays([pa.array(_suffix_hashes(hashes, texts[a:b], run)[2].view(np.int64))], ["key"])

    return docs.where("text is not null").select("text").mapInArrow(scan, "key long")


def suffixes(docs: DataFrame, known, run: int = RUN, every: bool = False) -> DataFrame:
    """(key, id, pos, lead) of the word suffixes of ``docs`` (id string, text) whose key the Bloom filter ``known`` has; ``lead`` are the first ``run`` words.

    A suffix whose lead occurs before in its text is left out, unless ``every`` place is asked for. Null ids and null texts give nothing.
    """

    def scan(rows):
        hashes = WordHashes()
        for batch in rows:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts):
                tokens, starts, keys, owner, pos = _suffix_hashes(hashes, texts[a:b], run)
                at = np.flatnonzero(bloom.might_have(known, keys))
                keys, owner, pos = keys[at], owner[at], pos[at]
                if len(keys) and not every:
                    at = first_of_each(owner, keys)
                    keys, owner, pos = keys[at], owner[at], pos[at]
                leads = [" ".join(tokens[i : i + run]) for i in (starts[owner] + pos).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids.take(pa.array(owner + a)), pa.array(pos, pa.int32()), pa.array(leads, pa.string())], ["key", "id", "pos", "lead"])

    return docs.where("id is not null and text is not null").select("id", "text").mapInArrow(scan, "key long, id string, pos int, lead string")


def _search(rows):
    """Binary search of the test suffixes (side 1) in the sorted array of the training suffixes (side 0) of a shard."""
    parts = [pa.Table.from_batches([batch]) for batch in rows]
    if not parts:
        return
    both = pa.concat_tables(parts).combine_chunks()
    side = both["side"].to_numpy()
    if side.all() or not side.any():
        return
    # the alphabet's order: words are letters and digits, all above the blank between them, so leads as strings sort by their words.
    # Parts of a shard that meet in a task stay apart by their salt, which comes after the words
    order = pc.rank(both["lead"], sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    salt = both["salt"].to_numpy().astype(np.int64)
    place = order * (salt.max() + 1) + salt
    train, test = both.filter(pa.array(side == 0)).combine_chunks(), both.filter(pa.array(side == 1)).combine_chunks()
    array, wanted = place[side == 0], place[side == 1]
    suffix = np.argsort(array, kind="stable")
    array = array[suffix]
    low, high = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
    found = np.flatnonzero(high > low)
    counts = high[found] - low[found]
    ends = np.cumsum(counts)
    at = 0
    total = int(ends[-1]) if len(ends) else 0
    while at < total:
        flat = np.arange(at, min(at + HITS_PER_BLOCK, total))
        which = np.searchsorted(ends, flat, "right")
        t = found[which]
        r = pa.array(suffix[low[t] + (flat - (ends[which] - counts[which]))])
        t = pa.array(t)
        yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (train["id"].take(r), test["id"].take(t), train["pos"].take(r), test["pos"].take(t))], ["record_id", "item_id", "record_pos", "item_pos"])
        at += HITS_PER_BLOCK


def hits(records: DataFrame, items: DataFrame, run: int = RUN, every: bool = False) -> DataFrame:
    """(record_id, item_id, record_pos, item_pos): each run of ``run`` words that both have. Inputs: (id, text).

    With ``every``, at all pairs of its places; else at its first place in both.

    Positions count words. Empty inputs and texts of fewer words give no rows; rows repeated under
    one id repeat their hits.
    """
    spark = records.sparkSession
    keys = cut(suffix_keys(items, run))
    known = bloom.build(keys, keys.count())
    train = cut(suffixes(records, known, run, every))
    n_train = train.count()
    known_too = bloom.build(train, n_train)
    test = suffixes(items, known_too, run, every)
    shard = F.shiftrightunsigned("key", 64 - SHARD_BITS).cast("int")
    sizes = train.groupBy(shard.alias("shard")).count()  # at most 2**SHARD_BITS rows
    salts = F.broadcast(sizes.select("shard", F.ceil(F.col("count") / ROWS_PER_SHARD).cast("int").alias("salts")))
    train = train.withColumn("shard", shard).join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int"))
    test = test.withColumn("shard", shard).join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = train.select(F.lit(0).alias("side"), "lead", "id", "pos", "shard", "salt").unionByName(test.select(F.lit(1).alias("side"), "lead", "id", "pos", "shard", "salt"))
    width = shuffle_width(spark, 2 * n_train, ROWS_PER_SHARD)
    return both.repartition(width, "shard", "salt").select("side", "lead", "id", "pos", "salt").mapInArrow(_search, "record_id string, item_id string, record_pos int, item_pos int")


def matches(records: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Maximal verbatim matches: (record_id, item_id, record_pos, item_pos, match_words), words counted from 0."""
    one = hits(records, items, run, every=True).withColumn("diagonal", F.col("record_pos") - F.col("item_pos")).dropDuplicates(["record_id", "item_id", "diagonal", "item_pos"])
    along = Window.partitionBy("record_id", "item_id", "diagonal").orderBy("item_pos")
    island = one.withColumn("island", F.col("item_pos") - F.row_number().over(along))
    return (
        island.groupBy("record_id", "item_id", "diagonal", "island")
        .agg(F.min("record_pos").alias("record_pos"), F.min("item_pos").alias("item_pos"), (F.count("*") + run - 1).cast("int").alias("match_words"))
        .select("record_id", "item_id", "record_pos", "item_pos", "match_words")
    )


def leaked_pairs(records: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(record_id, item_id) with a run of ``run`` words in common."""
    return hits(records, items, run).select("record_id", "item_id").distinct()


def leak_report(records: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Per record concerned: how many items leaked into it, the longest match, its item and places (ties: smaller item id)."""
    best = F.max_by(F.struct("item_id", "record_pos", "item_pos"), F.struct("match_words", F.negative("record_pos")))
    m = matches(records, items, run)
    return m.groupBy("record_id").agg(F.count_distinct("item_id").alias("n_items"), F.max("match_words").alias("longest_words"), best.alias("b")).select(
        "record_id", "n_items", "longest_words", F.col("b.item_id").alias("longest_item"), F.col("b.record_pos").alias("record_pos"), F.col("b.item_pos").alias("item_pos")
    )


def without_leaks(records: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``records`` less those of ``pairs`` (record_id); rows with a null key stay."""
    return records.join(pairs.select(F.col("record_id").alias(key)).distinct(), key, "left_anti")
