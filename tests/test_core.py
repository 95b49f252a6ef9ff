"""Core operators against plain-Python statements of their rules."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import unicodedata
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.functions.python_udfs import luhn, normalize_text, redact, redact_text
from siltstone.operators import construction, dedup, evaluation, gates, metrics, mining, reports, robustness, sampling, scoring, spans
from siltstone.sources import crawl, lake, readers

TEXTS = ["", "one", "Hello, world! It's the end of the day.\n\n\nNext  line here", "- a\n- b\n- c\nthe rest", "Zażółć gęślą jaźń №5 — ¿qué?", "same\nsame\nsame\nother", "x_y 12 3.5 a1b2", "A​B­C <b>bold</b> [link](http://a.b) &amp;lt; &nbsp;z"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id long, text string").cache()


def column(df, c):
    return [r[0] for r in df.where("text is not null").orderBy("id").select(c).collect()]


def test_text_scalars(texts):
    import re

    t = F.col("text")
    word = re.compile(r"\w+")
    assert column(texts, T.token_count(t)) == [len(x.split()) for x in TEXTS]
    assert column(texts, T.symbol_ratio(t)) == pytest.approx([sum(not re.match(r"[\w\s]", c) for c in x) / len(x) if x else 1.0 for x in TEXTS])
    assert column(texts, T.mean_word_length(t)) == pytest.approx([sum(map(len, word.findall(x))) / len(word.findall(x)) if word.findall(x) else 0.0 for x in TEXTS])
    assert column(texts, T.unique_word_ratio(t)) == pytest.approx([len(set(word.findall(x.lower()))) / len(word.findall(x)) if word.findall(x) else 0.0 for x in TEXTS])
    assert column(texts, T.repeated_line_ratio(t))[5] == 0.5
    assert texts.where("id = 99").select(T.symbol_ratio(t), T.mean_word_length(t), T.token_count(t)).first()[1] is None
    assert column(texts, T.strip_invisible(t))[7].startswith("ABC")
    assert column(texts, T.strip_markup(t))[7].split() == ["A​B­C", "bold", "link", "<", "z"]
    assert column(texts, T.collapse_whitespace(t))[2] == "Hello, world! It's the end of the day.\n\nNext line here"
    assert [len(x) for x in column(texts, T.shingle_hashes(t, 2))] == [len({tuple(w[i : i + 2]) for i in range(len(w) - 1)} or w) for w in (word.findall(x.lower()) for x in TEXTS)]
    assert column(texts, T.structure_of(t))[3] == "listy"


def test_normalize_and_redact(spark):
    assert normalize_text("ﬁne &amp;lt;​ <p>x</p>") == "fine < x"
    assert normalize_text(unicodedata.normalize("NFD", "é")) == "é" and normalize_text("раy", True) == "pay"
    card = "4539 1488 0343 6467"
    assert luhn(card) and not luhn("4539 1488 0343 6468") and not luhn("42")
    text, kinds = redact_text(f"mail a.b@c.org, card {card}, 4539148803436468, ip 10.0.0.1, ssn 123-45-6789, call 555-123-4567")
    assert kinds == ["CREDIT_CARD", "EMAIL", "IP", "PHONE", "SSN"] and "4539148803436468" in text and "[EMAIL]" in text
    df = spark.createDataFrame([(f"mail a@b.com {card}",), (None,)], "text string")
    assert df.select(T.pii_kinds(F.col("text"))).first()[0] == ["CREDIT_CARD", "EMAIL"]
    assert [r[0] for r in df.select(redact("text").alias("r")).select("r.kinds").collect()][1] is None


def test_generation_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.render_template("On {topic} in {n} words", {"topic": F.lit("bees"), "n": F.lit("9")})) == "On bees in 9 words"
    with pytest.raises(KeyError):
        T.render_template("{nope}", {})
    assert one(T.strip_wrapper(F.lit("# Title\nBody here.\nLet me know if you need more"))) == "Body here."
    assert one(T.starts_as_assistant(F.lit("Sure, here it is:\ntext"))) and not one(T.starts_as_assistant(F.lit("Surely not")))
    src = F.lit("alpha beta gamma delta epsilon zeta eta theta iota")
    assert one(T.copies_verbatim(F.array(F.lit("one two three four five")), src)) and not one(T.copies_verbatim(F.array(F.lit("alpha beta")), src))


def test_splits_and_choices(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    for r in df.select("k", H.split_of_group(F.col("k")).alias("s"), H.digest_number(F.col("k"), "family").alias("n")).collect():
        bucket = int(hashlib.sha256((r.k + H.SALT).encode()).hexdigest()[:8], 16) % 10_000
        assert r.s == ("train" if bucket < 8000 else "val" if bucket < 9000 else "test")
        assert r.n == int(hashlib.sha256(f"{r.k}|family".encode()).hexdigest()[:12], 16)


def test_gates_and_policies(spark):
    p = gates.CleaningPolicy.from_config({"length": {"min_chars": 10, "min_tokens": 2}, "language": {"min_score": 0.0}})
    data = [("a", "good words are here and fine", "en"), ("b", "short", "en"), ("c", "ein ganz anderer text hier", "de"), ("d", "!!!! ???? ,,,, ;;;;", "en"), ("", "good words are here", "en"), ("f", None, "en"), ("g", "good words no language", None)]
    df = spark.createDataFrame(data, "id string, text string, lang string")
    got = [r[0] for r in df.select(gates.reject_reason(F.col("id"), F.col("text"), F.col("lang"), F.lit(1.0), p)).collect()]
    assert got == [None, "too_short_chars", "language", "high_symbol_ratio", "empty_or_unidentified", "empty_or_unidentified", "language"]
    with pytest.raises(TypeError):
        gates.CleaningPolicy.from_config({"length": {"nope": 1}})


def minhash_by_hand(text, n=128):
    values = dedup.shingle_values(text)
    return [min(((a * int(x) + b) % dedup.MERSENNE) & dedup.MASK_32 for x in values) for a, b in dedup.permutations(n)]


def test_minhash_is_exact():
    text = "the quick brown fox jumps over the lazy dog and runs away from it all"
    assert dedup.minhash_rows(dedup.shingle_values(text)).tolist() == minhash_by_hand(text)
    assert (dedup.minhash_rows(np.array([], dtype=np.uint64)) == dedup.MASK_32).all()


def test_first_wins_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept = []
    for i in range(42):
        if not any((j, i) in set(edges) for j in kept):
            kept.append(i)
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "a long, b long, similarity double")
    out = {r.id: r.duplicate_of for r in dedup.first_wins(spark.range(42), pairs).collect()}
    assert sorted(i for i, d in out.items() if d is None) == kept and all(d in kept for d in out.values() if d is not None)
    assert dedup.first_wins(spark.range(3), pairs.limit(0)).where("duplicate_of is null").count() == 3


def test_near_pairs_and_hamming(spark):
    base = " ".join(f"w{i}" for i in range(120))
    docs = [(1, base), (2, " ".join(f"w{i}" for i in range(6, 126))), (3, base), (4, " ".join(f"v{i}" for i in range(120))), (5, None), (6, "")]
    sig = dedup.signatures(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    assert {(r.a, r.b) for r in dedup.banded_pairs(sig).collect()} == {(1, 2), (2, 3), (1, 3)}
    rng = random.Random(1)
    h = [rng.getrandbits(63) for _ in range(20)]
    h += [x ^ (1 << (i * 3)) ^ (1 << (i * 3 + 1)) for i, x in enumerate(h)]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if (h[i] ^ h[j]).bit_count() <= 6}
    df = spark.createDataFrame(list(enumerate(h)) + [(99, None)], "id long, hash long")
    assert {(r.a, r.b) for r in dedup.hamming_pairs(df).collect()} == want


def test_contamination_of_equal_benchmark_texts(spark, tmp_path):
    from siltstone.plans.measures import contamination_near

    base, other = " ".join(f"w{i}" for i in range(120)), " ".join(f"v{i}" for i in range(120))
    spark.createDataFrame([("b1", base), ("b2", base), ("b3", "W0  " + base[3:]), ("b4", other), ("b5", None)], "doc_id string, text string").write.parquet(str(tmp_path / "benchmark_docs.parquet"))
    spark.createDataFrame([("t2", base), ("t1", base), ("t3", " ".join(f"w{i}" for i in range(6, 126))), ("t2", base)], "doc_id string, text string").write.parquet(str(tmp_path / "raw_examples.parquet"))
    got = contamination_near(spark, str(tmp_path)).collect()
    assert sorted((r.eval_id, r.train_id, r.similarity) for r in got) == [("b1", "t1", 1.0), ("b2", "t1", 1.0), ("b3", "t1", 1.0)]


def test_quotas(spark):
    def of(make, *tables, **more):
        kind = "g string, n long" if not tables[0] or isinstance(next(iter(tables[0])), str) else "g long, n long"
        return {r.g: r.quota for r in make(*(spark.createDataFrame(list(t.items()), kind) for t in tables), "g", **more).collect()}

    assert of(sampling.cap_quotas, {"train": 80, "val": 10, "test": 10}, cap=50) == {"test": 5, "train": 40, "val": 5}
    assert of(sampling.cap_quotas, {"a": 3, "b": 4}, cap=9) == {"a": 3, "b": 4} and of(sampling.cap_quotas, {"a": 99, "b": 1}, cap=3) == {"a": 3, "b": 0}
    assert of(sampling.largest_remainder, {"a": 1, "b": 1, "c": 1}, budget=2) == {"a": 1, "b": 1, "c": 0}
    assert of(sampling.proportional_quotas, {1: 100, 2: 30, 3: 5}, budget=60) == {1: 36, 2: 18, 3: 5}  # one pass over the leftovers, so a full cluster's share stays unspent
    assert of(sampling.proportional_quotas, {1: 100, 2: 101}, budget=7) == {1: 3, 2: 4} and of(sampling.proportional_quotas, {1: 2, 2: 9, 3: 9}, budget=15) == {1: 2, 2: 7, 3: 6}
    assert of(sampling.proportional_quotas, {}, budget=5) == {}
    assert of(sampling.matched_quotas, {"x": 50, "y": 3}, {"x": 10, "y": 10}, cap=20) == {"x": 17, "y": 3}
    assert of(sampling.matched_quotas, {"x": 4, "y": 3, "z": 9}, {"x": 1}, cap=12) == {"x": 4, "y": 3, "z": 5}
    assert of(sampling.matched_quotas, {"x": 2}, {"y": 10}, cap=12) == {"x": 2, "y": 0}
    both = [spark.createDataFrame(list(t.items()), "g string, n long") for t in ({"x": 50, "y": 3}, {"x": 10, "y": 10})]
    assert sampling.matched_budget(*both, "g").first().budget == 6


def test_units_given_in_rounds_equal_the_rounds(spark):
    rng = random.Random(5)
    for case in range(6):
        rooms, amount = {f"g{i}": rng.randrange(9) for i in range(7)}, rng.randrange(40)
        left, given = amount, dict.fromkeys(rooms, 0)
        while left and any(given[g] < rooms[g] for g in rooms):
            for g in sorted(rooms, key=lambda g: (-rooms[g], g)):
                if left and given[g] < rooms[g]:
                    given[g] += 1
                    left -= 1
        out = sampling.filled(spark.createDataFrame(list(rooms.items()), "g string, room long"), "g", "room", F.lit(amount), "more")
        assert {r.g: r.more for r in out.collect()} == given


def test_cluster_holdout():
    train, held = sampling.cluster_holdout(list(range(12)))
    assert train and held and sorted(train + held) == list(range(12)) and sampling.cluster_holdout([]) == ([], [])


def test_samples_are_nested(spark):
    df = spark.range(300)
    small, large = ({r.id for r in sampling.subsample(df, "id", n).collect()} for n in (20, 60))
    assert len(small) == 20 and small < large and sampling.subsample(df, "id", 0).count() == 0


def test_metrics(spark):
    rng = random.Random(2)
    y, s = [rng.randrange(2) for _ in range(300)], [round(rng.random(), 1) for _ in range(300)]
    df = spark.createDataFrame(list(zip(y, s)), "y_true int, score double")
    pairs = [(a > b) + (a == b) / 2 for la, a in zip(y, s) for lb, b in zip(y, s) if la and not lb]
    assert metrics.auroc(df).first()[0] == pytest.approx(sum(pairs) / len(pairs))
    human = sorted(x for x, label in zip(s, y) if not label)
    k = math.ceil(0.9 * len(human)) - 1
    assert metrics.threshold_at_fpr(df, 0.1) == math.nextafter(human[k], math.inf)
    assert metrics.auroc(df.where("y_true = 1")).first()[0] is None and metrics.rates(df.where("y_true = 1"), 0.5).first().fpr is None
    assert metrics.exact_binomial(0, 0) == 1.0 and metrics.exact_binomial(1, 9) == pytest.approx(22 / 1024)
    cost = metrics.condition_cost(df, 0.5).first()
    assert cost.p95 == human[math.ceil(0.95 * len(human)) - 1] and cost.maximum == human[-1]
    with pytest.raises(ValueError):
        metrics.threshold_at_fpr(df.where("y_true = 1"), 0.1)


def test_silhouette_covers_all_rows(spark):
    rng = np.random.default_rng(4)
    label = np.array([0] * 1500 + [1] * 700 + [2] * 100 + [3] * 3 + [4] + [-1] * 20)
    x = rng.normal(size=(len(label), 3)) + label[:, None]
    real = label != mining.NOISE
    d = np.sqrt(((x[real][:, None] - x[real][None]) ** 2).sum(-1))
    mean = {c: d[:, label[real] == c].sum(axis=1) for c in range(5)}
    size = np.bincount(label[real])
    scores = []
    for i, c in enumerate(label[real]):
        if size[c] > 1:
            a, b = mean[c][i] / (size[c] - 1), min(mean[o][i] / size[o] for o in range(5) if o != c)
            scores.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "id long, cluster int, v array<double>")
    for block in (4096, 300):
        got = mining.silhouette(df, block=block).first()
        assert got.n == len(scores) and got.silhouette == pytest.approx(np.mean(scores), abs=1e-9)
    assert mining.silhouette(df.where("cluster = 0")).first().silhouette is None
    assert math.isnan(mining.silhouette(df.where("id in (0, 1, 1500)").withColumn("v", F.array(F.lit(1.0)))).first().silhouette)


def test_paired_bootstrap_is_exact(spark):
    from siltstone.operators.resampling import paired_bootstrap, weights

    rng = random.Random(6)
    rows = [(f"d{i}", i % 2, 1 - rng.random() * 1e-5 + (i % 2) * 2e-6, rng.choice([-3.0, 1.0, 1.0, 1.0, 4.5]) + (i % 2) * 0.5 * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, y_true int, a double, b double")
    w = np.array([weights(k, 40) for k, *_ in rows])
    y = np.array([r[1] for r in rows])

    def area(s):
        s = np.array(s)
        wins = (s[:, None] > s[None]) + (s[:, None] == s[None]) / 2
        p, n = w * (y == 1)[:, None], w * (y == 0)[:, None]
        return np.einsum("ir,ij,jr->r", p, wins, n) / (p.sum(axis=0) * n.sum(axis=0))

    d = area([r[3] for r in rows]) - area([r[2] for r in rows])
    got = paired_bootstrap(df, 40).first()
    exact = [metrics.auroc(df.withColumnRenamed(c, "score")).first()[0] for c in "ab"]
    assert got.difference == pytest.approx(exact[1] - exact[0], abs=1e-12) and got.resamples == 40
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(d[:-1], [2.5, 97.5])), abs=1e-12)
    few = df.where("doc_id in ('d0', 'd1', 'd2', 'd3', 'd4', 'd5')")
    w = np.array([weights(f"d{i}", 10_000)[:-1] for i in range(6)])
    assert paired_bootstrap(few).first().resamples == ((w[::2].sum(axis=0) > 0) & (w[1::2].sum(axis=0) > 0)).sum() > 9000 * (1 - math.exp(-3)) ** 2


def test_spans(spark):
    n = spark.createDataFrame([(x,) for x in (0, 1, 512, 513, 896, 897)], "n int").select("n", spans.windows(F.col("n")).alias("w"))
    got = {r.n: [(x.start, x.end) for x in r.w] for r in n.collect()}
    assert got[0] == [] and got[512] == [(0, 512)] and got[513] == [(0, 512), (384, 513)] and got[896] == [(0, 512), (384, 896)] and len(got[897]) == 3
    rows = [("a", [(0, 3, "human"), (3, 9, "ai_generated")]), ("b", [(1, 9, "human")]), ("c", [(0, 4, "human"), (5, 9, "human")]), ("d", [(0, 5, "human")]), ("e", []), ("f", None)]
    df = spark.createDataFrame(rows, "k string, s array<struct<start_char:int,end_char:int,label:string>>")
    assert [r[0] for r in df.orderBy("k").select(spans.tiling_fault(F.col("s"), F.lit(9))).collect()] == [None, "bad_start", "gap_or_overlap", "bad_end", "no_spans", "no_spans"]
    assert spans.labels_of([(0, 2), (2, 5), (7, 7), (20, 22)], [(0, 3, "human"), (3, 9, "ai_generated")]) == [0, 2, -100, 2]
    assert spans.labels_of([(0, 4), (5, 6), (6, 8)], [(4, 5, "ai_assisted"), (0, 2, "human"), (2, 4, "ai_generated")]) == [0, 1, 1] and spans.labels_of([(0, 1)], []) == [-100]
    assert all(spans.window_bounds(x) == got[x] for x in got)
    text = df.limit(1).select(F.lit("ab cd ef").alias("t"), F.lit(None).cast("array<struct<start_char:int,end_char:int,label:string>>").alias("s")).select(spans.token_labels("t", "s").alias("x"))
    assert text.first().x.labels is None
    counts = spans.match_counts(spark.createDataFrame([("a", [0, 1, 1, 0, 2, 2], [0, 1, 1, 0, 0, 2])], "k string, y_true array<int>, y_pred array<int>"), "k").first()
    assert (counts.seg_tp, counts.n_true, counts.n_pred) == (2, 2, 2)


def test_constructed_documents(spark):
    human, other = ("\n\n".join(f"{c} paragraph {i} " + "word " * 20 for i in range(3)) for c in ("human", "other"))
    text, parts, reason = construction.splice(human, other, "a|b")
    assert reason is None and parts[0][0] == 0 and parts[-1][1] == len(text) and {x for *_, x in parts} == {"human", "ai_generated"}
    assert construction.splice("one", other, "k")[2] == "human_too_few_paragraphs"
    e = construction.edit_spans("the cat sat on the mat today and slept well all through the night", "the cat sat on the rug today and slept well all through the night")
    assert [x for *_, x in e] == ["human", "ai_assisted", "human"]
    q = spark.createDataFrame([("q", i, n) for i, n in enumerate([10, 20, 5, 40, 1])], "k string, pos int, n int")
    assert [r.batch for r in construction.packed_batches(q, "k").orderBy("pos").collect()] == [0, 0, 1, 2, 3]


def test_attacks(spark):
    text = "Many big rivers end because the small stream needs help. It is important. However, a mill can begin."
    for name, attack in robustness.ATTACKS.items():
        for severity in robustness.SEVERITIES[name]:
            assert attack(text, "k", severity) == attack(text, "k", severity)
        assert name == "sentence_reorder" or attack(text, "k", 0.0).split() == text.split()
    assert normalize_text(robustness.ATTACKS["zero_width_insert"](text, "k", 1.0)) == text
    with pytest.raises(NotImplementedError):
        robustness.attack_column("paraphrase_llm", 1.0)
    with pytest.raises(ValueError):
        robustness.attack_column("nope", 1.0)


def test_evaluation_rules(spark):
    with pytest.raises(ValueError):
        evaluation.decision(F.lit(0.5), 0.9, 0.1, 0.2)
    ev = spark.createDataFrame([(1, 1, "under_review", "v", "ai"), (1, 2, "verified", None, "ai"), (1, 3, "verified", "v", "ai"), (1, 4, "rejected", "v", "ai"), (2, 1, "verified", "v", "ai")], "item int, pos int, to string, verifier string, label string")
    out = {r.item: r.r for r in evaluation.transition_faults(ev).collect()}
    assert out[1].state == "verified" and [x.fault for x in out[1].log] == [None, "unverified_label", None, "illegal"] and out[2].state == "submitted"
    gate = evaluation.release_gate(spark.createDataFrame([("fpr", 0.5)], "metric string, value double"), {"max_fpr": 0.1, "max_fnr": 0.5}).collect()
    assert all(r.failed for r in gate) and len(gate) == 2
    small = spark.createDataFrame([(0.5,)] * 10, "v double")
    assert evaluation.drift_report(small, small, "v").first().severity == "unmeasurable"
    with pytest.raises(ValueError):
        evaluation.require(small, ["w"])
    with pytest.raises(ValueError):
        mining.confident_errors(small, small, 0.9, 0.5)


def warc(kind, name, body):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_sources(spark, tmp_path):
    seg = tmp_path / "seg"
    seg.mkdir()
    (seg / "a.wet.gz").write_bytes(gzip.compress(warc("warcinfo", "i", b"x")) + gzip.compress(warc("conversion", "r1", b"hello")) + gzip.compress(warc("conversion", "r2", b"  ")))
    (seg / "b.wet.gz").write_bytes(gzip.compress(warc("conversion", "r3", b"lost") + warc("conversion", "r4", b"cut off")[:-8]))
    records, stats = readers.warc_segments(spark, str(seg), crawl="c1")
    assert [(r.source_record_id, r.text, r.source_config) for r in records.collect()] == [("r1", "hello", "c1")]
    assert {r.segment[-8:]: (r.n_records, r.error is None) for r in stats.collect()} == {"a.wet.gz": (1, True), "b.wet.gz": (0, False)}
    assert readers.html_text(b"HTTP/1.1 200\r\n\r\n<html><head><title>t</title></head><body><nav>menu</nav><p>One</p><script>x()</script><p>Two &amp; three</p></body></html>") == "One\nTwo & three"
    (tmp_path / "in.jsonl").write_text('{"id": "a", "text": "x", "license": "mine"}\n{"text": "y"}\n')
    assert [(r.source_record_id, r.text, r.license) for r in readers.jsonl(spark, str(tmp_path / "in.jsonl")).orderBy("source_record_id").collect()] == [("1", "y", "unknown"), ("a", "x", "mine")]
    books = tmp_path / "books"
    books.mkdir()
    (books / "b1.txt").write_text("junk\n*** START OF THE BOOK ***\n\nCall me\n\n*** END OF THE BOOK ***\nlicence")
    book = readers.text_files(spark, str(books), "gut", True).first()
    assert (book.source_record_id, book.text) == ("b1", "Call me")
    with pytest.raises(ValueError):
        readers.reader("nope")


def test_lake(spark, tmp_path):
    df = spark.createDataFrame([("b", "s1", "train", "2"), ("a", "s1", "val", "1")], "doc_id string, source string, split string, text string")
    assert sorted(map(tuple, lake.write_partitioned(df, str(tmp_path / "out"), "source", "split").collect())) == [("s1", "train", 1), ("s1", "val", 1)]
    assert lake.manifest(df, "source", "doc_id").first().ids_sha256 == hashlib.sha256(b"a\nb").hexdigest()
    line = hashlib.sha256(b"a\nb\n").hexdigest()[:16]
    assert lake.fingerprint(df, "doc_id").first().fingerprint == line
    assert lake.tree_fingerprint(df, "doc_id").first() == lake.tree_fingerprint(df.orderBy("doc_id"), "doc_id").first()
    shards = df.withColumn("sha", F.sha2("doc_id", 256))
    lake.write_shards(shards, str(tmp_path / "shards"), "sha", "doc_id", 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2


def test_entry_without_the_subpackage():
    import importlib
    import sys

    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("siltstone.llm") or k == "__spark_entry__"}
    sys.modules["siltstone.llm"] = None
    try:
        entry = importlib.import_module("__spark_entry__")
        assert not any(n.startswith("p1_") for n in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        del sys.modules["siltstone.llm"]
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(hidden)


def test_calibration(spark):
    from siltstone.operators.calibration import abstention_band, fit_temperature

    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        x = rng.gauss(0, 2)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-x))), 0.0, 2.5 * x))
    t, edge = fit_temperature(spark.createDataFrame(rows, "y_true int, human_logit double, ai_logit double"))
    assert abs(t - 2.5) < 0.4 and not edge
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(100)], "y_true int, score double")
    low, high = abstention_band(df, 0.1, 0.1)
    assert 0 <= low <= high <= 1 and abstention_band(df, 0.1, 0.0)[0] == abstention_band(df, 0.1, 0.0)[1]


def test_pool_audit(spark, tmp_path):
    spark.range(5).selectExpr("id as doc_id", "'x' as text").coalesce(1).write.parquet(str(tmp_path / "pool"))
    assert [r.n for r in lake.pool_audit(spark, str(tmp_path / "pool"), ["doc_id", "text"]).collect()] == [5]
    with pytest.raises(ValueError):
        lake.pool_audit(spark, str(tmp_path / "pool"), ["missing"])


def test_scoring_with_an_injected_model(spark):
    docs = spark.createDataFrame([("a", "one two three four five six"), ("b", "bad word"), ("c", ""), ("d", None), (None, "x y"), ("e", "seven")], "doc_id string, text string")

    def make():
        def score(windows):
            if any("bad" in w for w in windows):
                raise RuntimeError("no score")
            return [len(w.split()) / 4 for w in windows]

        return score

    out = {r.doc_id: r for r in scoring.scored_documents(docs, "words", make, 4, 2).collect()}
    assert set(out) == {"a", "b", "e"} and (out["a"].score_mean, out["a"].score_max, out["a"].n_windows) == (1.0, 1.0, 2)
    assert out["b"].failed and out["b"].score_mean is None and not out["e"].failed
    totals = scoring.scan_totals(spark.createDataFrame(list(out.values())), 0.5).first()
    assert (totals.scanned, totals.errors, totals.above_threshold) == (3, 1, 1)
    labelled = spark.createDataFrame([("a", [(0, 0), (1, 2), (3, 4)], [-100, 0, 2]), ("b", [], [])], "doc_id string, offsets array<struct<start:int,end:int>>, labels array<int>")
    rows = [(r.window, r.char_start, r.char_end, r.fraction, r.label) for r in scoring.windowed_examples(labelled, 2, 1).orderBy("window").collect()]
    assert rows == [(0, 1, 2, 0.0, 0), (1, 1, 4, 0.5, 1)]


def test_crawl_plans(spark, tmp_path):
    (tmp_path / "wet.paths.gz").write_bytes(gzip.compress(b"a/1.wet\nb/2.wet\n\nc/3.wet\n"))
    paths = crawl.segment_index(spark, str(tmp_path / "wet.paths.gz"))
    assert paths == ["a/1.wet", "b/2.wet", "c/3.wet"] and crawl.segment_index(spark, str(tmp_path / "wet.paths.gz"), 1) == paths[:1]
    with pytest.raises(crawl.CrawlError):
        crawl.segment_index(spark, str(tmp_path / "none.gz"))
    plan = crawl.plan_crawl(spark, "c", paths, partitions=2)
    assert plan.buckets() == [["a/1.wet", "c/3.wet"], ["b/2.wet"]] and plan.fingerprint == hashlib.sha256(b"a/1.wet\nb/2.wet\nc/3.wet\n").hexdigest()[:16]
    assert crawl.plan_crawl(spark, "c", ["/x/2.wet", "/y/1.wet"]).fingerprint == hashlib.sha256(b"1.wet\n2.wet\n").hexdigest()[:16]
    for wrong in ({"fmt": "pdf"}, {"paths": []}, {"paths": ["a", "a"]}, {"partitions": 9}, {"shards": 0}):
        with pytest.raises(crawl.CrawlError):
            crawl.plan_crawl(spark, "c", **({"paths": paths} | wrong))


def test_reports(spark, tmp_path):
    e = spark.createDataFrame([("r", 1, 0.5, 0.0), ("r", 2, 0.01, 0.9), ("r", 3, 0.0, 0.9), ("s", 2, 0.3, 0.1), ("s", 1, 0.3, 0.2)], "run string, step int, fpr double, fnr double")
    assert {r.run: (r.step, r.in_budget) for r in reports.best_checkpoint(e, "run", 0.01).collect()} == {"r": (2, True), "s": (1, False)}
    marks = spark.createDataFrame([("Human-GPT",), ("my_gpt-j",), ("reddit",)], "s string").select(reports.evidence(F.col("s")))
    assert [r[0] for r in marks.collect()] == ["human", "generator", "none"]
    roster = spark.createDataFrame([("x", "held_out"), ("y", "held_in")], "family string, role string")
    leaks = reports.held_out_leaks(spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "f string"), "f", roster)
    assert [tuple(r) for r in leaks.collect()] == [("x", 2)]
    with pytest.raises(ValueError):
        reports.require_no_leaks(leaks, "f")
    images = spark.createDataFrame([("b", "train", "cc"), ("a", "val", "x" * 5000), ("c", None, "cc"), ("b", "train", "cc")], "image_id string, split string, license string")
    assert {r.image_id: r.fault for r in reports.manifest_faults(images, "image_id").collect()} == {"a": "oversized_field", "b": "repeated", "c": "no_split"}
    reports.manifest_lines(images.where("image_id <> 'a'").distinct(), "image_id").write.text(str(tmp_path / "m"))
    assert sorted(r.image_id for r in spark.read.schema(images.schema).json(str(tmp_path / "m")).collect()) == ["b", "c"]
    one = lambda c: spark.range(1).select(c).first()[0]
    plain = {f: F.lit("a plain thing") for f in reports.CAPTION_FIELDS}
    assert one(reports.caption_fault(plain)) is None and one(reports.caption_prompt(plain)).startswith("scene: a plain thing. objects: ")
    for value, fault in (("  ", "empty"), ("x" * 401, "too_long"), ("see www.x.org", "identifying"), ("Jane Doe there", "identifying"), ("© me", "identifying")):
        assert one(reports.caption_fault(plain | {"objects": F.lit(value)})) == f"{fault}:objects"
    report = evaluation.contamination_report(spark.createDataFrame([("e", "h"), ("f", "k")], "id string, h string"), spark.createDataFrame([("t", "h"), ("u", "h")], "id string, h string"), "h")
    with pytest.raises(ValueError):
        evaluation.require_clean(report, "bench")


def test_training_readers(spark, tmp_path):
    data = [("a", "g", "one two", "web", "train", 2), ("b", "g", "three", None, "val", 1)]
    df = spark.createDataFrame(data, "doc_id string, source_group_id string, text string, domain string, split string, token_count int")
    df.withColumn("source", F.lit("x")).withColumn("_s", F.col("split")).write.partitionBy("_s").parquet(str(tmp_path / "human"))
    assert sorted(r.doc_id for r in readers.humans(spark, str(tmp_path / "human")).collect()) == ["a", "b"] and readers.humans(spark, str(tmp_path / "human"), 1).count() == 1
    assert readers.length_pool(readers.parts(spark, str(tmp_path / "human"))).count() == 2
    mixed = df.select("doc_id", "source_group_id", "text", "domain", "split", F.array(F.struct(F.lit(0).alias("start_char"), F.lit(3).alias("end_char"), F.lit("ai_generated").alias("label"))).alias("spans"))
    out = {r.doc_id: r for r in readers.training_rows(None, None, mixed, ["train", "val"]).collect()}
    assert out["a"].label == 0 and out["b"].label == 1 and out["b"].domain == "unknown"
    lake.write_parts(df, str(tmp_path / "mirror"), "fam1")
    lake.write_parts(df, str(tmp_path / "mirror"), "fam2")
    assert readers.parts(spark, str(tmp_path / "mirror")).count() == 4 and {r.split: r.n for r in lake.write_parts(df, str(tmp_path / "mirror"), "fam3").collect()} == {"train": 1, "val": 1}


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from siltstone import runtime

    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)
    with runtime.scratch(spark):
        path = runtime.cut(spark.range(3)).inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert Path(path).exists()
    assert not Path(path).exists()


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("k"))
    assert all(r.n == r.k for r in runtime_numbered(df).collect()) and runtime_numbered(df.limit(0)).count() == 0


def runtime_numbered(df):
    from siltstone.runtime import numbered

    return numbered(df, "n", "k")


def test_ranks_over_ranges_equal_a_sort(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randrange(2), rng.choice([0.999, 0.001, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, y_true int, score double")
    for r in metrics.ranked_counts(df, ["g"]).collect():
        own = [s for g, _, s in data if g == r.g]
        assert r.below == sum(s < r.score for s in own) and r.n == own.count(r.score)
    cost = {r.g: r for r in metrics.condition_cost(df, 0.5, ["g"]).collect()}
    for g, r in cost.items():
        own = sorted(s for x, y, s in data if x == g and not y)
        assert (r.n_human, r.p95, r.maximum) == (len(own), own[math.ceil(0.95 * len(own)) - 1], own[-1]) and r.median == pytest.approx(float(np.median(own)))


def test_hot_keys_are_split(spark):
    keys = spark.range(60).select(F.col("id").alias("node"), F.when(F.col("id") < 50, 1).otherwise(F.col("id") % 3 + 2).alias("key"))
    plain, split = (sorted(map(tuple, dedup.met_within(keys, block).collect())) for block in (4_000, 8))
    assert plain == split and len(plain) == 50 * 49 // 2 + sum(n * (n - 1) // 2 for n in (4, 3, 3))


def test_first_wins_by_hamming_distance(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(62) for _ in range(5)]
    data = [(i, base[i % 5] ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(4)))) for i in range(60)] + [(100, None), (101, base[0]), (102, base[0])]
    kept, want = [], {}
    for i, h in data:
        near = [(bin(h ^ k).count("1"), j) for j, k in kept if bin(h ^ k).count("1") <= 6] if h is not None else []
        want[i] = min(near)[1] if near else None
        if not near and h is not None:
            kept.append((i, h))
    out = {r.id: r.duplicate_of for r in dedup.hamming_first_wins(spark.createDataFrame(data, "id long, hash long")).collect()}
    assert {i for i, d in out.items() if d is None} == {i for i, d in want.items() if d is None}


@pytest.fixture
def small_broadcasts(spark):
    """What a driver broadcasts may take 3 MB."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def _families(n: int, bits: int) -> list[int]:
    """Hashes in families of 40, each with a run of ``bits`` ones flipped at its own place."""
    return [random.Random(i // 40).getrandbits(62) ^ ((1 << bits) - 1) << i % 59 for i in range(n)]


def test_hamming_first_wins_broadcasts_no_keys(spark, small_broadcasts):
    h, kept, want = _families(6000, 3), {}, {}
    for i, x in enumerate(h):
        near = [((x ^ h[j]).bit_count(), j) for j in kept.get(i // 40, []) if (x ^ h[j]).bit_count() <= 4]
        want[i] = min(near)[1] if near else None
        if not near:
            kept.setdefault(i // 40, []).append(i)
    out = {r.id: r.duplicate_of for r in dedup.hamming_first_wins(spark.createDataFrame(list(enumerate(h)), "id long, hash long"), 4).collect()}
    assert out == want


def test_hamming_pairs_broadcast_no_keys(spark, small_broadcasts):
    h = _families(4000, 1)
    out = sorted(map(tuple, dedup.hamming_pairs(spark.createDataFrame(list(enumerate(h)), "id long, hash long")).collect()))
    assert out == [(i, j, (h[i] ^ h[j]).bit_count()) for i in range(4000) for j in range(i + 1, i // 40 * 40 + 40)]


def test_hot_keys_of_hamming_blocks_are_split(spark):
    rng = random.Random(8)
    h = list({rng.getrandbits(8) | rng.getrandbits(8) << 56 for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in h], "node long")
    for most, agree in ((6, 3), (0, 3)):
        plain, split = (sorted(map(tuple, dedup._near_nodes(nodes, most, agree, block).collect())) for block in (4_000, 8))
        near = {(d, frozenset(p)) for p in combinations([r.node for r in nodes.collect()], 2) if (d := ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count()) <= most}
        assert plain == split and all(m < n for m, n, _ in plain) and len(plain) == len(near) and {(d, frozenset((m, n))) for m, n, d in plain} == near


def test_digests_stream_over_sorted_lines(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None), (None, "x"), ("d", "y")], "k string, g string")
    got = {r.g: (r.n_docs, r.ids_sha256) for r in lake.manifest(df, "g", "k").collect()}
    assert got == {"x": (2, hashlib.sha256(b"a\nb").hexdigest()), "y": (1, hashlib.sha256(b"d").hexdigest())}
    assert tuple(lake.fingerprint(df, "k").first()) == (hashlib.sha256(b"a\nb\nc\nd\n").hexdigest()[:16], 4)
    assert tuple(lake.fingerprint(df.limit(0), "k").first()) == (hashlib.sha256(b"").hexdigest()[:16], 0)


def test_generation_faults():
    source = " ".join(f"w{i}" for i in range(60))
    fault = lambda text, target=60, src=None: construction.fault_of(text, target, src)
    assert [fault(""), fault("Sure, here it is:\n" + source), fault("a b c"), fault(source * 2 + source), fault(source), fault(source, 60, source)] == ["empty", "assistant_preamble", "too_short", "too_long", None, "near_duplicate_of_source"]


def test_streamed_duplicates_over_batches(spark, tmp_path):
    from siltstone.streaming import streams

    folder = tmp_path / "events.parquet"
    for i in range(3):
        spark.createDataFrame([(i * 5, "a"), (i * 5, f"n{i}")], "hours int, k string").select(F.timestamp_add("HOUR", F.col("hours"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), "k").coalesce(1).write.mode("append").parquet(str(folder))
    stream = lambda: streams.timed(streams.stream_table(spark, str(tmp_path), "events", files_per_batch=1))
    ever, lately = streams.drain(streams.first_of_hash(stream(), ["k"])), streams.drain(streams.first_of_hash_lately(stream(), ["k"]))
    assert sorted(r.k for r in ever.collect()) == ["a", "n0", "n1", "n2"]
    assert {r.k for r in lately.collect()} == {"a", "n0", "n1", "n2"}


def test_one_pass_cleaning_equals_the_columns(spark):
    from siltstone.functions.python_udfs import normalize
    from siltstone.plans.ingest import clean, judged_records

    rng = random.Random(7)
    words = "the mill of a river and it was not in their house don't Où été ÀÉ x_1 42 naïve".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([20, 60, 90]))) for _ in range(60)]
    texts += ["#$% " * 90, "same line here is the one\n" * 20, "a b " * 90, "word " * 90, "", "  ", None, "mail a.b@c.org " + texts[0] + " " + texts[1], "pneumonoultramicroscopic " * 60, "the end of the house.\n\n" * 30, "l'été de la maison " * 40]
    data = [(f"r{i}" if i % 9 else None, "s", None, None, None, None, None, t, (rng.choice(["en", "fr", None]), rng.choice([0.9, 0.5, None]))) for i, t in enumerate(texts)]
    schema = "source_record_id string, source_id string, source_config string, license string, domain string, register string, acquired_at timestamp, text string, upstream_language struct<lang:string,score:double>"
    df = spark.createDataFrame(data + data[-1:], schema)
    policy = gates.CleaningPolicy()
    judged = judged_records(df, policy)
    c = F.col("text")
    language, score, detector = T.detect_language(c, F.col("upstream_language.lang"), F.col("upstream_language.score"))
    columns = df.withColumn("text", normalize("text")).select("source_record_id", F.coalesce(gates.reject_reason(F.col("source_record_id"), c, language, score, policy), F.lit("kept")).alias("reason"), detector.alias("detector"), F.length("text").alias("n"))
    ours = judged.select("source_record_id", F.coalesce(F.regexp_replace("reject_reason", ".*_after_redaction", "kept"), F.lit("kept")).alias("reason"), "detector", F.length("text").alias("n"))
    assert sorted((str(r[0]), r[1], r[2]) for r in ours.collect()) == sorted((str(r[0]), r[1], r[2]) for r in columns.collect())
    assert len({r.reason for r in ours.collect()}) > 5
    out = clean(df).collect()
    assert len({r.doc_id for r in out}) == len(out) and all(r.split in ("train", "val", "test") for r in out) and clean(df.limit(0)).count() == 0


def test_conditions_of_a_robustness_run(spark):
    df = spark.createDataFrame([("A <b>Tést</b>  hеre", 1), (None, 2)], "text string, k int")  # the e of "here" is Cyrillic
    got = {r.condition: r.text for r in robustness.under_conditions(df, list(robustness.CONDITIONS)).collect()}
    assert got == {"raw": "A <b>Tést</b>  hеre", "normalised": "A Tést hеre", "folded": "A Tést here", "casefolded": "a tést here"}
    for wrong in (["raw"], ["normalised", "nope"]):
        with pytest.raises(ValueError):
            robustness.under_conditions(df, wrong)
    text = " ".join(f"word{i} and" for i in range(60))
    assert robustness.preserves_meaning(text, text.replace("a", "а")) and not robustness.preserves_meaning(text, "something else " * 30) and not robustness.preserves_meaning("", text)
    attacked = spark.createDataFrame([("x", 0.1, "raw", 0.2), ("x", 0.1, "raw", 0.9)], "attack string, severity double, condition string, score double")
    row = robustness.condition_table(attacked, spark.createDataFrame([("raw", 0.9)], "condition string, score double"), 0.5).first()
    assert (row.n, row.fnr, row.clean_fnr, row.delta) == (2, 0.5, 0.0, 0.5)


def test_small_reports(spark):
    rows = [(1, 0.9, 0.2)] * 12 + [(1, 0.1, 0.8)] * 3 + [(1, 0.9, 0.9), (0, 0.1, 0.9)]
    r = metrics.mcnemar_values(spark.createDataFrame(rows, "y_true int, a double, b double"), 0.5, 0.5).first()
    assert sorted((r.b, r.c)) == [3, 12] and r.p_exact == pytest.approx(2 * sum(math.comb(15, i) for i in range(4)) / 2**15) and r.p_chi2 == pytest.approx(math.erfc(math.sqrt(r.chi2 / 2)))
    with pytest.raises(ValueError):
        metrics.chance_margin(0)
    queue = spark.createDataFrame([("q", i, 40 if i == 2 else 12) for i in range(6)], "k string, pos long, n long")
    assert [x.batch for x in construction.packed_batches(queue, "k").orderBy("pos").collect()] == [0, 0, 1, 2, 2, 3]
    with pytest.raises(Exception, match="more than 5"):
        construction.packed_batches(queue, "k", 32, 5).collect()
    segments = spark.createDataFrame([("b", 10, 4, "w", 1.5, None), ("a", 0, 0, "w", 0.5, "x")], "segment string, seen long, kept long, worker string, seconds double, error string")
    assert tuple(gates.merge_segments(segments).first()) == (1, ["a"], 10, 4, 0.4, 1, 1.5, 2.0)
