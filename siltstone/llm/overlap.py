"""Problem 2: held-out rows that also stand in train, by sharded Aho-Corasick automata.

Evaluation records are held in shards; the automaton of a shard knows every three-word run of its
records. It scans the training texts that can concern it; the intervals its matches cover in each evaluation
record are merged to the record's coverage, which decides whether the pair is looked at further: a pair at
``least`` covers at least ``least`` of the record's distinct runs. The distinct runs found then give the exact similarity.

Every training text is read whole, against a Bloom filter of the held-out runs: a text of ``n`` distinct runs that is
similar at ``least`` shares ``ceil(least * n)`` of them, so texts with fewer in the filter are done. Scanning
each of the others with each shard would be quadratic, so they are routed: both sides order their runs
alike (runs not held out first, then by how often they are held out, from counters broadcast with the filter, then by
fingerprint), and a similar pair shares SHARED of the first ``n - ceil(least * n) + SHARED`` at least (or all it must share, if
that is less). No similar pair is lost that way, and nothing but fingerprints is shuffled for it; the words travel only for texts that met a record.

A run that many texts have is split: both sides know its level from the counters and spread
it over blocks of either side. Texts with equal words are one class, routed and scanned once. Shards many texts
are routed to are split by salt, each part with the shard's records.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import bloom
from siltstone.llm.neardup import class_id
from siltstone.llm.textwork import WordHashes, batches, first_of_each, mix, run_fingerprints, words
from siltstone.runtime import cut, shuffle_width

LEAST_WORDS = 20
RECORDS_PER_SHARD = 200
TEXTS_PER_PART = 5_000
KEYS_PER_TASK = 1_500_000
PAIRS_PER_BATCH = 500_000
#: How many of their first runs two texts must share to be routed.
SHARED = 4
#: Runs on more than ``2 ** SPLIT_LEVEL`` texts of a side are split into blocks of about so many.
SPLIT_LEVEL = 12
MOST_SEEN = 2_000_000


def _classed(rows):
    """(id, text) batches as (id, cls, n_words, words) of the texts with LEAST_WORDS words; null words where the task gave the class before."""
    seen: set[int] = set()
    for batch in rows:
        at, classes, sizes, joined = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = words(text)
            if len(own) >= LEAST_WORDS:
                cls = class_id(own)
                at.append(i)
                classes.append(cls)
                sizes.append(len(own))
                joined.append(None if cls in seen else " ".join(own))
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.add(cls)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(joined, pa.string())], ["id", "cls", "n_words", "words"])


def _runs(hashes: WordHashes, texts: list[list[str]], shingle: int):
    """(key, text number, position) of the runs of word lists."""
    return run_fingerprints(hashes.of([w for own in texts for w in own]), np.array([len(own) for own in texts]), shingle)


def _distinct_runs(hashes: WordHashes, texts: list[list[str]], shingle: int):
    """(key, text number, n per text) of the distinct runs of word lists."""
    keys, owner, _ = _runs(hashes, texts, shingle)
    first = first_of_each(owner, keys)
    return keys[first], owner[first], np.bincount(owner[first], minlength=len(texts))


def _run_keys(shingle: int):
    """(words) batches as the keys of their distinct runs."""

    def scan(rows):
        hashes = WordHashes()
        for batch in rows:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                keys, _, _ = _distinct_runs(hashes, [t.split(" ") for t in texts[a:b]], shingle)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return scan


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * n - 1e-9).astype(np.int64)


def _firsts(keys: np.ndarray, owner: np.ndarray, level: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Indices of the first ``most[owner]`` keys of each owner by (level, key); owners come in order."""
    order = np.lexsort((keys, level, owner))
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o, "left")
    return order[rank < most[o]]


def _screened(shingle: int, least: float, known):
    """(id, text) of training as (id, cls, n, words, keys): only texts with enough runs in the filter, with the runs that route them.

    A class its task gave before has null words and no keys.
    """

    def scan(rows):
        hashes, seen = WordHashes(), {}
        for batch in rows:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts, 2_000_000):
                at, classes, fresh, split = [], [], [], []
                for i in range(a, b):
                    own = words(texts[i])
                    if len(own) < LEAST_WORDS:
                        continue
                    cls = class_id(own)
                    if cls not in seen:
                        if len(seen) > MOST_SEEN:
                            seen.clear()
                        seen[cls] = None  # not judged yet
                        fresh.append(len(at))
                        split.append(own)
                    at.append(i)
                    classes.append(cls)
                if not at:
                    continue
                own_keys: dict[int, tuple[int, str, np.ndarray]] = {}
                if split:
                    keys, owner, n = _distinct_runs(hashes, split, shingle)
                    had = bloom.might_have(known, keys)
                    hits = np.bincount(owner, had, minlength=len(split)).astype(np.int64)
                    enough = hits >= _needed(n, least)
                    on = np.flatnonzero(had & enough[owner])
                    keys, owner = keys[on], owner[on]
                    pick = _firsts(keys, owner, bloom.level_of(known, keys), hits - _needed(n, least) + SHARED)
                    keys, owner = keys[pick], owner[pick]
                    for k in np.flatnonzero(enough):
                        lo, hi = np.searchsorted(owner, [k, k + 1])
                        own_keys[fresh[k]] = (int(n[k]), " ".join(split[k]), keys[lo:hi])
                    for k, row in enumerate(fresh):
                        seen[classes[row]] = int(n[k]) if enough[k] else 0
                kept = [k for k in range(len(at)) if seen.get(classes[k])]
                lists = [own_keys[k][2] if k in own_keys else np.zeros(0, np.uint64) for k in kept]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
                flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([at[k] for k in kept], pa.int64())), pa.array([classes[k] for k in kept], pa.int64()), pa.array([seen[classes[k]] for k in kept], pa.int32()),
                        pa.array([own_keys[k][1] if k in own_keys else None for k in kept], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64))),
                    ],
                    ["id", "cls", "n", "words", "keys"],
                )

    return scan


def _cells(keys: np.ndarray, cls: np.ndarray, n: np.ndarray, held: bool, known, known_too, split: int):
    """Batch (key, held, cls, n): each key once, or in the blocks of its side against all of the other's if it is on many texts."""
    blocks = [1 << np.maximum(0, bloom.level_of(f, keys).astype(np.int64) - split) for f in (known_too, known)]  # train, held
    ours, others = (blocks[1], blocks[0]) if held else (blocks[0], blocks[1])
    mine = mix(cls.view(np.uint64)).astype(np.int64) % ours if len(keys) else ours
    at = np.repeat(np.arange(len(keys)), others)
    other = np.arange(len(at)) - np.repeat(np.cumsum(others) - others, others)
    pair = (other << 24) + mine[at] if not held else (mine[at] << 24) + other
    keys = keys[at] ^ np.where(pair == 0, np.uint64(0), mix(pair.astype(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(at), held)), pa.array(cls[at]), pa.array(n[at].astype(np.int32))], ["key", "held", "cls", "n"])


def _training_cells(known, known_too):
    level = SPLIT_LEVEL

    def scan(rows):
        for batch in rows:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            cls, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield _cells(flat, cls[at], n[at], False, known, known_too, level)

    return scan


def _held_cells(shingle: int, least: float, known, known_too):
    level = SPLIT_LEVEL

    def scan(rows):
        hashes = WordHashes()
        for batch in rows:
            classes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in batches(texts):
                keys, owner, n = _distinct_runs(hashes, [t.split(" ") for t in texts[a:b]], shingle)
                at = _firsts(keys, owner, bloom.level_of(known, keys), n - _needed(n, least) + SHARED)
                at = at[bloom.might_have(known_too, keys[at])]
                keys, owner = keys[at], owner[at]
                yield _cells(keys, classes[a:b][owner], n[owner], True, known, known_too, level)

    return scan


def _met(least: float):
    """(train, record, need, n): how many keys of a batch two classes have in common whose numbers of runs allow the similarity, and how many they need.

    A partition comes sorted by key.
    """

    def emit(key, held, cls, n):
        order = np.lexsort((cls, held, key))
        key, held, cls, n = key[order], held[order], cls[order], n[order]
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (held[1:] != held[:-1]) | (cls[1:] != cls[:-1])
        key, held, cls, n = key[keep], held[keep], cls[keep], n[keep]
        left, right = np.flatnonzero(~held), np.flatnonzero(held)
        low, high = np.searchsorted(key[right], key[left], "left"), np.searchsorted(key[right], key[left], "right")
        ends = np.cumsum(high - low)
        total, at = int(ends[-1]) if len(ends) else 0, 0
        while at < total:
            flat = np.arange(at, min(at + PAIRS_PER_BATCH, total))
            i = np.searchsorted(ends, flat, "right")
            j = right[low[i] + flat - (ends[i] - (high - low)[i])]
            i = left[i]
            ok = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[ok], j[ok]
            both = mix(cls[i].view(np.uint64) + mix(cls[j].view(np.uint64)))
            _, first, times = np.unique(both, return_index=True, return_counts=True)
            i, j = i[first], j[first]
            need = np.minimum(SHARED, _needed(np.maximum(n[i], n[j]), least))
            yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j]), pa.array(need.astype(np.int32)), pa.array(times.astype(np.int64))], ["train", "record", "need", "n"])
            at += PAIRS_PER_BATCH

    def stream(rows):
        held_back = None  # rows of a key that may go on in the next batch
        for batch in rows:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held_back is not None:
                cols = [np.concatenate(x) for x in zip(held_back, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            if last:
                yield from emit(*[c[:last] for c in cols])
            held_back = [c[last:] for c in cols]
        if held_back is not None and len(held_back[0]):
            yield from emit(*held_back)

    return stream


class Shard:
    """Automaton over the runs of some evaluation records."""

    def __init__(self, records: list[tuple[int, str]], shingle: int):
        self.shingle, self.vocabulary, self.ids, self.records, owners = shingle, {}, {}, [], []
        for cls, text in records:
            numbered = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split(" ")]
            order = []
            for run in zip(*(numbered[k:] for k in range(shingle))):
                number = self.ids.setdefault(run, len(self.ids))
                if number == len(owners):
                    owners.append([])
                if not owners[number] or owners[number][-1] != len(self.records):
                    owners[number].append(len(self.records))
                order.append(number)
            self.records.append((cls, order, len(set(order))))
        self.owners = owners
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for run, number in self.ids.items():
            self.automaton.add_word(run, number)
        self.automaton.make_automaton()

    def scan(self, text: str, least: float):
        """(record, similarity, coverage, intervals) of the records a text covers far enough and is similar to."""
        tokens = text.split(" ")
        numbered = tuple(self.vocabulary.get(w, 0) for w in tokens)
        found = {number for _, number in self.automaton.iter(numbered)}
        common: dict[int, int] = {}
        for number in found:
            for r in self.owners[number]:
                common[r] = common.get(r, 0) + 1
        n = 0
        for r, k in common.items():
            cls, order, own = self.records[r]
            if k < least * own - 1e-9:  # covers less than any similar pair does
                continue
            covered = end = intervals = 0
            for at, number in enumerate(order):
                if number in found:
                    intervals += at > end or not covered
                    covered += at + self.shingle - max(at, end)
                    end = at + self.shingle
            n = n or len(set(zip(*(tokens[k:] for k in range(self.shingle)))))
            if k >= least * (n + own - k):
                yield cls, k / (n + own - k), covered / (len(order) + self.shingle - 1), intervals


def _scan_shards(shingle: int, least: float):
    """Rows (shard, salt, train, cls, words), sorted by the first four, so that a part's records precede its training texts."""

    def scan(rows):
        part, last, records, automaton = None, None, [], None
        for batch in rows:
            out = []
            for shard, salt, train, cls, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, salt) != part:
                    part, last, records, automaton = (shard, salt), None, [], None
                if (train, cls) == last:  # a class that several tasks gave
                    continue
                last = (train, cls)
                if not train:
                    records.append((cls, text))
                    continue
                if automaton is None:
                    automaton = Shard(records, shingle)
                out += [(cls, *x) for x in automaton.scan(text, least)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32()))], ["train", "record", "similarity", "coverage", "intervals"])

    return scan


def overlaps(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Membership (id, held, cls) and overlapping classes (train, record, similarity, coverage, intervals).

    ``docs``: (id string, held boolean, text); rows with a null are left out, as are texts of fewer than
    LEAST_WORDS words. Rows repeated under one id count once. Training rows too far from all records have no
    membership. Empty inputs give empty frames.
    """
    spark = docs.sparkSession
    docs = docs.where("id is not null and text is not null and held is not null")
    records = cut(docs.where("held").select("id", "text").mapInArrow(_classed, "id string, cls long, n_words int, words string"))
    worded = records.where("words is not null")
    n_runs = worded.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    known = bloom.build(worded.select("words").mapInArrow(_run_keys(shingle), "key long"), n_runs, levels=True)
    texts = cut(docs.where("not held").select("id", "text").mapInArrow(_screened(shingle, least, known), "id string, cls long, n int, words string, keys array<long>"))
    n_keys = texts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    known_too = bloom.build(texts.select(F.explode("keys").alias("key")), n_keys, levels=True)
    cell = "key long, held boolean, cls long, n int"
    cells = texts.where("words is not null").select("cls", "n", "keys").mapInArrow(_training_cells(known, known_too), cell).unionByName(worded.select("cls", "words").mapInArrow(_held_cells(shingle, least, known, known_too), cell))
    cells = cells.repartition(shuffle_width(spark, 2 * n_keys, KEYS_PER_TASK), "key").sortWithinPartitions("key")
    shared = cells.mapInArrow(_met(least), "train long, record long, need int, n long").groupBy("train", "record", "need").agg(F.sum("n").alias("n"))
    routes = cut(shared.where("n >= need").select("train", "record"))

    sizes = routes.agg(F.count_distinct("record").alias("r"), F.count("*").alias("n")).first()
    shard = F.pmod(F.xxhash64("record"), F.lit(max(1, math.ceil(sizes["r"] / RECORDS_PER_SHARD)))).cast("int")
    met = routes.select(shard.alias("shard"), F.col("train").alias("cls")).distinct()
    parts = met.groupBy("shard").agg(F.ceil(F.count("*") / TEXTS_PER_PART).cast("int").alias("parts"))
    near = routes.select(shard.alias("shard"), F.col("record").alias("cls")).distinct().join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("train"), "cls")
    met = met.join(parts, "shard").select("shard", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts").cast("long")).cast("int").alias("salt"), F.lit(True).alias("train"), "cls")
    rows = near.join(worded.select("cls", "words"), "cls").unionByName(met.join(texts.where("words is not null").select("cls", "words"), "cls"))
    width = shuffle_width(spark, sizes["n"], TEXTS_PER_PART)
    rows = rows.select("shard", "salt", "train", "cls", "words").repartition(width, "shard", "salt").sortWithinPartitions("shard", "salt", "train", "cls")
    found = rows.mapInArrow(_scan_shards(shingle, least), "train long, record long, similarity double, coverage double, intervals int")
    members = records.select("id", F.lit(True).alias("held"), "cls").unionByName(texts.select("id", F.lit(False).alias("held"), "cls")).distinct()
    return members, found


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return members.where("not held").select(F.col("cls").alias("train"), F.col("id").alias("train_id")), members.where("held").select(F.col("cls").alias("record"), F.col("id").alias("held_id"))


def as_row_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """(train_id, held_id, similarity, coverage) of all rows in overlapping classes; an id never overlaps itself."""
    a, b = _sides(members)
    return found.join(a, "train").join(b, "record").where("train_id <> held_id").select("train_id", "held_id", "similarity", "coverage")


def _found_keys(shingle: int, known):
    """(id, text) as (key, lo, hi): runs the filter has, each with the least and greatest id of the batch's texts that have it."""

    def scan(rows):
        hashes = WordHashes()
        for batch in rows:
            ids, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            for a, b in batches(texts):
                split = [words(t) for t in texts[a:b]]
                split = [own if len(own) >= LEAST_WORDS else [] for own in split]
                keys, owner, _ = _runs(hashes, split, shingle)
                at = np.flatnonzero(bloom.might_have(known, keys))
                place = np.argsort(np.argsort(ids[a:b].astype(str), kind="stable"), kind="stable")[owner[at]]
                order = np.lexsort((place, keys[at]))
                keys, owner = keys[at][order], owner[at][order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(keys)) - 1 if len(keys) else first
                yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(ids[a:b][owner[first]], pa.string()), pa.array(ids[a:b][owner[last]], pa.string())], ["key", "lo", "hi"])

    return scan


def _run_places(shingle: int):
    """(cls, words) as (cls, pos, key): every run of a text."""

    def scan(rows):
        hashes = WordHashes()
        for batch in rows:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                keys, owner, pos = _runs(hashes, [t.split(" ") for t in texts[a:b]], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + a, pa.int64())), pa.array(pos, pa.int32()), pa.array(keys.view(np.int64))], ["cls", "pos", "key"])

    return scan


def record_coverage(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, n_words, covered, coverage, intervals): each held-out record, with the word intervals of it (start, end) that its runs found in any training text cover.

    Inputs as for ``overlaps``. Training texts needn't be similar to the record: the intervals are merged over all of them,
    but for those of its own id. Records without a run found have coverage 0.
    """
    docs = docs.where("id is not null and text is not null and held is not null")
    records = cut(docs.where("held").select("id", "text").mapInArrow(_classed, "id string, cls long, n_words int, words string"))
    worded = records.where("words is not null").select("cls", "words").dropDuplicates(["cls"])
    n_runs = records.where("words is not null").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    known = bloom.build(records.where("words is not null").select("words").mapInArrow(_run_keys(shingle), "key long"), n_runs)
    keys = docs.where("not held").select("id", "text").mapInArrow(_found_keys(shingle, known), "key long, lo string, hi string").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    runs = worded.mapInArrow(_run_places(shingle), "cls long, pos int, key long")
    records = records.select("id", "cls", "n_words").distinct()
    # least and greatest training id of a run: one at least is another's, unless only the record's own id has it
    found = records.select("id", "cls").join(runs.join(keys, "key"), "cls").where("lo <> id or hi <> id").select("id", "cls", "pos")
    along = Window.partitionBy("id", "cls").orderBy("pos")
    apart = F.coalesce((F.col("pos") - F.lag("pos").over(along) > shingle).cast("int"), F.lit(0))
    island = found.withColumn("apart", apart).withColumn("island", F.sum("apart").over(along)).groupBy("id", "cls", "island").agg(F.min("pos").alias("start"), (F.max("pos") + shingle).alias("end"))
    per = island.groupBy("id", "cls").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("intervals"))
    covered = F.coalesce("covered", F.lit(0))
    none = F.expr("array()").cast("array<struct<start:int,end:int>>")
    return records.join(per, ["id", "cls"], "left").select("id", "n_words", covered.alias("covered"), (covered / F.col("n_words")).alias("coverage"), F.coalesce("intervals", none).alias("intervals"))


def overlap_counts(members: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Per split and source of the held-out rows: (split, source, n_rows, n_overlapping, n_train). ``docs``: (id, split, source).

    ``n_train`` adds up the training rows each held-out row overlaps, by the sizes of the classes: copies aren't expanded.
    """
    a, b = _sides(cut(members))
    found = cut(found.select("train", "record").distinct())
    sizes = a.groupBy("train").agg(F.count("*").alias("k"))
    per = found.join(sizes, "train").groupBy("record").agg(F.sum("k").alias("k"))
    own = a.join(b, a["train_id"] == b["held_id"]).select("train", "record", F.col("held_id").alias("id")).join(found, ["train", "record"]).groupBy("id").agg(F.count("*").alias("self"))
    n = b.join(per, "record").groupBy(F.col("held_id").alias("id")).agg(F.sum("k").alias("k")).join(own, "id", "left").select("id", (F.col("k") - F.coalesce("self", F.lit(0))).alias("n")).where("n > 0")
    held = docs.where("split in ('val', 'test')").dropDuplicates(["id"])
    return held.join(n, "id", "left").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_train"))
