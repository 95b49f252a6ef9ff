"""The operators of the training-data problems against brute force and on defined edge cases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("siltstone.llm.queries")

from siltstone.llm import bloom, groupsplit, language, leaks, mixing, neardup, overlap, packing, quality, spam, splitting, textwork  # noqa: E402
from siltstone.llm.dartminhash import EMPTY, band_keys, signatures  # noqa: E402

WORDS = ["alder", "brook", "cedar", "dune", "elm", "fern", "gorse", "heath", "iris", "juniper", "kelp", "larch", "moss", "nettle", "oak", "pine", "quince", "reed", "sedge", "thorn"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def runs(text, k):
    w = textwork.words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


# ---- words ----
def test_words_follow_the_definition():
    assert textwork.words("A<b>Be​ta</b> ﬁne_Ünder\r\n x²") == ["a", "beta", "fine", "ünder", "x2"]
    assert textwork.words(None) == [] and textwork.words("  ") == []


def test_run_fingerprints_are_equal_where_runs_are():
    a, b = "x a b c d e".split(), "a b c d e y".split()
    keys, owner, pos = textwork.run_fingerprints(textwork.WordHashes().of(a + b), np.array([len(a), len(b)]), 3)
    of = {(o, p): k for k, o, p in zip(keys.tolist(), owner.tolist(), pos.tolist())}
    assert of[0, 1] == of[1, 0] and of[0, 3] == of[1, 2] and of[0, 0] not in {of[1, i] for i in range(4)}
    assert len(textwork.run_fingerprints(textwork.WordHashes().of(["a"]), np.array([1]), 3)[0]) == 0


def test_bloom_has_all_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    shared = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "key long"), 5000)
    assert bloom.might_have(shared, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    assert bloom.might_have(shared, other.view(np.uint64)).mean() < 0.1
    often = np.repeat(keys, np.where(np.arange(5000) % 2, 1, 16))
    shared = bloom.build(spark.createDataFrame([(int(k),) for k in often], "key long"), 5000, levels=True)
    level = bloom.level_of(shared, keys.view(np.uint64))
    assert (level[::2] >= 4).all() and (level[1::2] == 0).mean() > 0.2


def test_bloom_filters_are_bounded():
    assert bloom.bits_for(10**13) == bloom.MOST_BITS == 8 * 64 * 2**20 and bloom.bits_for(0) >= bloom.SLICES * bloom.COUNTER_BITS
    assert [bloom.bits_for(n) >= 12 * n for n in (10**4, 10**6, 10**7)] == [True] * 3


# ---- p1 ----
def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ROWS_PER_SHARD", 40)  # every shard is salted
    passages = [prose(i, 40) for i in range(4)]
    recs = [(f"r{i}", prose(100 + i, 30) + " " + passages[i % 4][: 400 if i % 3 else 60] + " " + prose(200 + i, 20)) for i in range(24)]
    recs += [recs[0], ("r_null", None), (None, passages[0]), ("r_empty", ""), ("r_same", passages[1]), ("r_loop", "tic " * 300)]
    items = [(f"t{i}", p) for i, p in enumerate(passages)] + [("t_short", "one two"), ("t_null", None), ("t_loop", "tic " * 50)]
    recs += [("r_two", " ".join(passages[0].split()[:30] + passages[1].split()[:35]))]
    r, t = spark.createDataFrame(recs, "id string, text string"), spark.createDataFrame(items, "id string, text string")
    want = sorted({(a, b) for a, x in recs for b, y in items if a and x and y and runs(x, 24) & runs(y, 24)})
    assert rows(leaks.leaked_pairs(r, t)) == want
    best = {(x.record_id, x.item_id): x for x in leaks.matches(r, t).collect()}
    assert best["r_same", "t1"].match_words == 40 and best["r_same", "t1"].record_pos == 0
    report = {x.record_id: x for x in leaks.leak_report(r, t).collect()}
    assert report["r_same"].longest_item == "t1" and report["r_same"].n_items == 1
    clean = leaks.without_leaks(r, leaks.leaked_pairs(r, t), "id")
    assert {x.id for x in clean.collect()} == {a for a, _ in recs} - {a for a, _ in want}


def test_leaks_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, text string")
    some = spark.createDataFrame([("a", prose(1, 60))], "id string, text string")
    assert leaks.leaked_pairs(empty, some).count() == leaks.leaked_pairs(some, empty).count() == 0


# ---- near duplicates ----
def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (60, 200), dtype=np.uint64)
    other, changed = base.copy(), np.linspace(0, 200, 60).astype(int)
    for i, k in enumerate(changed):
        other[i, :k] = rng.integers(0, 2**63, k, dtype=np.uint64)
    own = np.repeat(np.arange(60), 200)
    a, b = signatures(base.ravel(), own, 60, 250), signatures(other.ravel(), own, 60, 250)
    assert np.abs((a == b).mean(axis=1) - (200 - changed) / (200 + changed)).max() < 0.15
    light, heavy = (signatures(base.ravel(), own, 60, 250, np.full(base.size, w)) for w in (1.5, 3.0))
    assert abs((light == heavy).mean() - 0.5) < 0.03
    assert (signatures(base[0], own[:200], 2, 250)[1] == EMPTY).all()
    assert band_keys(a, 50, 5).shape == (60, 50)


def variants(seed):
    rng = random.Random(seed)
    words = prose(seed, 80).split()
    out = [" ".join(words)]
    for _ in range(3):
        w = list(words)
        for _ in range(3):
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    return out + [" ".join(words[40:] + words[:40]), " ".join(words) + "!"]


def brute_pairs(docs, least, k, allowed=lambda a, b: True):
    sets = {i: runs(t, k) for i, t in docs if i and t and len(textwork.words(t)) >= 20}
    return sorted((a, b) for a in sets for b in sets if a < b and allowed(a, b) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


def test_matches_have_all_places_of_a_repeated_passage(spark):
    head, a, b = ([f"{c}{i}" for i in range(n)] for c, n in (("h", 40), ("a", 30), ("b", 60)))
    record, item = spark.createDataFrame([("r", " ".join(head + a + head + b))], "id string, text string"), spark.createDataFrame([("t", " ".join(head + b))], "id string, text string")
    got = {(m.record_pos, m.item_pos, m.match_words) for m in leaks.matches(record, item).collect()}
    assert got == {(0, 0, 40), (70, 0, 100)}
    best = leaks.leak_report(record, item).first()
    assert (best.longest_words, best.record_pos, best.item_pos) == (100, 70, 0)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)  # the family is a hot group, split into blocks
    monkeypatch.setattr(neardup, "SAMPLE_ONE_IN", 1)
    docs = [(f"{s:02d}_{i}", t) for s in range(6) for i, t in enumerate(variants(s))]
    docs += [docs[0], ("null", None), (None, prose(1, 40)), ("short", "too short"), ("loop", "go " * 200), ("loop2", "go " * 300), ("long", prose(9, 20_000))]
    df = spark.createDataFrame(docs, "id string, text string")
    members, pairs = neardup.near_duplicates(df, 0.6, 3)
    assert rows(neardup.as_record_pairs(members, pairs)) == brute_pairs(dict(docs).items(), 0.6, 3)
    links = {r.id: r for r in neardup.links_per_record(members, pairs).collect()}
    assert links["00_0"].n_copies == 1 and links["00_0"].n_links >= 3 and links["long"].n_links == 0
    m, p = neardup.near_duplicates(df.limit(0))
    assert m.count() == p.count() == 0


# ---- p2 ----
def test_overlaps_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "TEXTS_PER_PART", 2)
    monkeypatch.setattr(overlap, "RECORDS_PER_SHARD", 2)
    docs = [(f"{s:02d}_{i}", i % 3 == 0, t) for s in range(6) for i, t in enumerate(variants(s))]
    docs += [docs[0], ("null", True, None), ("no_side", None, prose(1, 40)), ("short", True, "too short")]
    df = spark.createDataFrame(docs, "id string, held boolean, text string")
    members, found = overlap.overlaps(df, 0.6, 3)
    side = {i: h for i, h, _ in docs}
    got = sorted(tuple(sorted((r.train_id, r.held_id))) for r in overlap.as_row_pairs(members, found).collect())
    assert got == brute_pairs([(i, t) for i, _, t in dict((d[0], d) for d in docs).values() if side[i] is not None], 0.6, 3, lambda a, b: side[a] != side[b])
    assert all(0.6 <= r.similarity <= 1 and r.coverage >= 0.6 for r in found.collect())
    pairs = overlap.as_row_pairs(members, found).collect()
    monkeypatch.setattr(overlap, "SPLIT_LEVEL", 0)  # every run on two texts is split into blocks
    members, found = overlap.overlaps(df, 0.6, 3)
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, overlap.as_row_pairs(members, found).collect()))
    splits = df.select("id", F.when(F.col("held"), "val").otherwise("train").alias("split"), F.lit("s").alias("source")).where("id <> 'no_side'")
    counts = overlap.overlap_counts(members, found, splits).first()
    assert counts.n_train == len(pairs) and counts.n_overlapping == len({p.held_id for p in pairs}) and counts.n_rows == len({i for i, h in side.items() if h})
    m, f = overlap.overlaps(df.limit(0))
    assert m.count() == f.count() == 0


def test_coverage_is_merged_over_training_texts(spark):
    w = lambda c, n: [f"{c}{i}" for i in range(n)]
    record = w("a", 30) + w("b", 30) + w("c", 30)
    docs = [("r1", True, record), ("r2", True, w("x", 40)), ("r3", True, w("y", 25)), ("r3", False, w("y", 25)), ("t1", False, w("p", 400) + record[5:20] + w("q", 300)), ("t2", False, w("s", 90) + record[15:40]), ("t3", False, record[70:90] + w("u", 200)), ("t4", False, record[50:52] + w("v", 50))]
    got = {r.id: r for r in overlap.record_coverage(spark.createDataFrame([(i, h, " ".join(t)) for i, h, t in docs], "id string, held boolean, text string"), 3).collect()}
    assert {i: ([(x.start, x.end) for x in r.intervals], r.covered) for i, r in got.items()} == {"r1": ([(5, 40), (70, 90)], 55), "r2": ([], 0), "r3": ([], 0)}
    assert got["r1"].coverage == pytest.approx(55 / 90)


# ---- p3 ----
@pytest.mark.parametrize("text", [prose(1, 900), ". ".join(prose(i, 12).capitalize() for i in range(80)), "x" * 5000, "é" * 3000, "a\r\n" * 2000, "word " * 10, "\n\n".join(prose(i, 60) + "." for i in range(12))])
def test_pieces_are_within_the_limit_and_overlap(text):
    limit, over = 700, 80
    pieces = splitting.cut_points(text, limit, over)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in pieces)
    assert all(b[0] == a[1] - over for a, b in zip(pieces, pieces[1:]))
    assert (len(pieces) > 1) == (len(text) > limit)


def test_cuts_prefer_the_change_of_topic():
    a = " ".join("Engine piston valve torque gasket piston engine." for _ in range(9))
    b = " ".join("Violin sonata cello chord melody violin sonata." for _ in range(9))
    (_, cut, kind), *_ = splitting.cut_points(a + " " + b, int(len(a) * 1.5), 0)
    assert kind == "sentence" and abs(cut - len(a)) <= 2


def test_paragraph_ends_are_preferred():
    text = " ".join(prose(i, 9).capitalize() + "." for i in range(20))
    at = text.index(". ", 900) + 1
    for gap in ("\n\n", "\r\n \r\n"):
        broken = text[:at] + gap + text[at + 1 :]
        (_, cut, kind), *_ = splitting.cut_points(broken, 1200, 0)
        assert (cut, kind) == (at + len(gap), "paragraph")


def test_large_overlaps_are_kept_and_impossible_ones_refused(spark):
    text = prose(5, 300)
    pieces = splitting.cut_points(text, 400, 350)
    assert all(b[0] == a[1] - 350 for a, b in zip(pieces, pieces[1:])) and all(b - a <= 400 for a, b, _ in pieces)
    with pytest.raises(ValueError):
        splitting.cut_points(text, 400, 400)
    docs = spark.createDataFrame([("a", "web", text, None)], "doc_id string, domain string, text string, spans array<struct<start_char:int,end_char:int,label:string>>")
    with pytest.raises(ValueError):
        splitting.pieces(docs, spark.createDataFrame([("web", 10, 10)], "domain string, max_chars int, overlap_chars int"))


def test_pieces_carry_spans(spark):
    text = prose(3, 400)
    span = lambda a, b: {"start_char": a, "end_char": b, "label": "human"}
    docs = [("a", "web", text, [span(0, 600), span(500, 99_999), span(7, 7)]), ("a", "web", text, [span(0, 600), span(500, 99_999), span(7, 7)]), ("b", None, text, None), ("c", "odd", text, []), ("d", "web", None, None), ("e", "web", "short", None)]
    df = spark.createDataFrame(docs, "doc_id string, domain string, text string, spans array<struct<start_char:int,end_char:int,label:string>>")
    limits = spark.createDataFrame([("web", 500, 50), ("unknown", 900, 90)], "domain string, max_chars int, overlap_chars int")
    out = splitting.pieces(df, limits).collect()
    assert {r.doc_id for r in out} == {"a", "b", "c"}
    for r in out:
        assert r.text == text[r.start_char : r.end_char] and len(r.text) <= (500 if r.doc_id == "a" else 900)
        assert (r.spans is None) == (r.doc_id == "b")
        for s in r.spans or []:
            assert 0 <= s.start_char < s.end_char <= len(r.text)
    assert splitting.pieces(df.limit(0), limits).count() == 0


# ---- p5 ----
COMMON = {"the": "en", "of": "en", "and": "en", "de": "es fr", "la": "es fr"}


def test_statistics_and_policy():
    lang, s = quality.statistics_of("The end of it. ok\nThe end of it. ok\nno stop", COMMON)
    assert lang == "en" and s[1] == pytest.approx(1 / 3) and s[4] == 0 and s[5] == pytest.approx(4 / 12)
    assert quality.statistics_of("!!!", COMMON)[1][:6] == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    limits = (0.2, 0.3, 2.5, 12.0, 0.2, 0.3, 0.1)
    assert quality.breaks_policy(limits, s) and not quality.breaks_policy((None,) * 7, s) and not quality.breaks_policy(None, s)


def test_scored_records(spark):
    good = [(f"g{i}", "a", ". ".join(f"the {w} of {prose(i, 3)} and the rest" for w in WORDS[:6]) + ".") for i in range(60)]
    bad = [("symbols", "a", "#$% " * 80), ("lines", "a", "same line here.\n" * 30), ("nosource", None, "#$% " * 50), ("unlimited", "b", "#$% " * 50), ("null", "a", None)]
    df = spark.createDataFrame(good + bad + bad[:1], "id string, source string, text string")
    out = {r.id: r for r in quality.scored(df, COMMON, {"a": (0.2, 0.3, 2.5, 12.0, 0.1, 0.3, 0.1)}).collect()}
    assert {i for i, r in out.items() if r.breaks} == {"symbols", "lines"} and "null" not in out
    for r in out.values():
        assert r.distance == pytest.approx(max(0, sum(r.contributions)) ** 0.5)
    assert out["symbols"].distance > max(out[f"g{i}"].distance for i in range(60)) and out["symbols"].suspect
    assert quality.scored(df.limit(0), COMMON, {}).count() == 0


# ---- p6 ----
def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best = {(): 0.0}
    value, back = scores[0].copy(), []
    for t in range(1, n):
        step = [[value[p] - (penalty[t] if p != s else 0) for p in range(k)] for s in range(k)]
        back.append([int(np.argmax(x)) for x in step])
        value = np.array([max(x) for x in step]) + scores[t]
    return float(value.max()), best


def path_value(scores, penalty, path):
    return sum(scores[t, s] - (penalty[t] if t and path[t - 1] != s else 0) for t, s in enumerate(path))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    lengths = np.array([7, 1, 12, 3])
    scores = rng.normal(size=(23, 4)).astype(np.float32)
    penalty = rng.uniform(0.2, 2, 23).astype(np.float32)
    path, at = language.viterbi(scores, lengths, penalty), 0
    for n in lengths:
        s, p = scores[at : at + n], penalty[at : at + n]
        assert path_value(s, p, path[at : at + n]) == pytest.approx(brute_viterbi(s, p)[0], abs=1e-4)
        at += n
    assert len(language.viterbi(np.zeros((0, 6), np.float32), np.array([], int), np.zeros(0, np.float32))) == 0
    n = 3000
    scores = rng.normal(size=(n, 6)).astype(np.float32)
    penalty = rng.uniform(0.2, 4, n).astype(np.float32)
    whole, blocked = language.viterbi(scores, np.array([n]), penalty), language._long_path(scores, penalty)  # what chains over LONG take
    assert path_value(scores, penalty, blocked) == pytest.approx(path_value(scores, penalty, whole), rel=1e-4)


def test_languages_of_paragraphs(spark):
    en, fr = "the house of the river and the old mill was not far from it in the end. ", "la maison de la rivière et le vieux moulin ne sont pas loin dans les bois avec nous. "
    common = {w: "en" for w in "the of and was not from it in".split()} | {w: "fr" for w in "la de et le ne sont pas dans les avec nous".split()}
    docs = [(f"e{i}", "en", en * 3) for i in range(8)] + [(f"f{i}", "fr", fr * 3) for i in range(8)]
    docs += [("mixed", "en", en * 2 + "\r\n\r\n" + fr * 2), ("wrong", "fr", en * 2), ("none", None, fr * 2), ("null", "en", None), ("blank", "en", "  "), ("greek", "en", "αβγ δεζ " * 20), ("short", "fr", en[:20])]
    df = spark.createDataFrame(docs, "id string, label string, text string")
    labelled = language.label_paragraphs(df, language.fit(df, common))
    assert rows(language.mislabelled(labelled)) == [("mixed", 1, "fr"), ("none", 0, "fr"), ("wrong", 0, "en")]
    of = {r.id: r for r in language.record_languages(labelled).collect()}
    assert of["greek"].lang == "el" and of["mixed"].n_languages == 2 and 0 < of["wrong"].confidence <= 1
    assert "null" not in of and "blank" not in of


def test_scripts_narrow_the_candidates(spark):
    en = "the house of the river and the old mill was not far from it in the end. "
    texts = {"el": "αβγ δεζ ηθι " * 9, "ru": "река дом поле " * 9, "zh": "河流 房子 " * 9, "ja": "かわ いえ " * 9, "ko": "강 집 들 " * 9, "he": "בית נהר " * 9, "ar": "بيت نهر " * 9, "th": "บ้าน แม่น้ำ " * 9, "half": en + "αβγ " * 3, "figures": "12 1905 7 " * 9}
    fr = "la maison de la rivière et le vieux moulin ne sont pas loin dans les bois avec nous. "
    docs = [(f"{k[0]}_{i}", k, v * 3) for i in range(8) for k, v in (("en", en), ("fr", fr))] + [(k, "en", v) for k, v in texts.items()]
    df = spark.createDataFrame(docs, "id string, label string, text string")
    model = language.fit(df.where("id like '__%' and id rlike '^._'"), {w: "en" for w in "the of and was not from it in".split()} | {w: "fr" for w in "la de et le ne sont pas dans les avec nous".split()})
    out = {r.id: r for r in language.label_paragraphs(df, model).collect()}
    assert {k: out[k].lang for k in texts} == {"el": "el", "ru": "und-Cyrl", "zh": "zh", "ja": "ja", "ko": "ko", "he": "he", "ar": "und-Arab", "th": "th", "half": "en", "figures": "und"}
    assert out["figures"].confidence == 0 and out["el"].confidence == 1 and out["half"].other_words == 3


def test_labels_stand_for_languages(spark):
    names = ["en_US", "GERMAN", "fre", " pt-BR ", "", "und", None, "nl", "xx"]
    df = spark.createDataFrame([(x,) for x in names], "l string").select(language.label_language(F.col("l")))
    assert [r[0] for r in df.collect()] == ["en", "de", "fr", "pt", None, None, None, "nl", None]


# ---- p7 ----
def components_by_hand(triples):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = {i for i, *_ in triples if i}
    for i, g, p, _ in triples:
        if i:
            find(i)
            if g:
                parent[find(i)] = find("g " + g)
            if p in ids:
                parent[find(i)] = find(p)
    out = collections.defaultdict(set)
    for i in ids:
        out[find(i)].add(i)
    return list(out.values())


def test_related_rows_equal_union_find(spark):
    rng = random.Random(4)
    data = [(f"d{i:03d}", rng.choice([None, *(f"g{k}" for k in range(40))]) if i % 3 else "hot", rng.choice([None, f"d{rng.randrange(120):03d}", "nowhere"]) if i % 4 == 0 else None, rng.choice(["train", "val", "test", None])) for i in range(120)]
    data += [(f"c{i:02d}", None, f"c{i + 1:02d}", "train" if i else "val") for i in range(30)] + [data[0], (None, "hot", None, "val"), ("self", None, "self", "val")]
    df = spark.createDataFrame(data, "id string, `group` string, parent string, split string")
    splits = collections.defaultdict(set)
    for i, _, _, s in data:
        splits[i].add(s)
    by_hand = components_by_hand(data)
    want = sorted((i,) for c in by_hand if len(set().union(*(splits[i] for i in c)) - {None}) > 1 for i in c)
    assert rows(groupsplit.tied_across_splits(df)) == want
    forest, labels = groupsplit.spanning_forest(df)
    tree = [(r.u, r.v) for r in forest.collect()]
    roots = {r.id: r.root for r in labels.collect()}
    groups = {f"g:{g}" for i, g, _, _ in data if i and g}
    assert len(set(tree)) == len(tree) == len(roots) + len(groups) - len(by_hand) - (len(groups - {v for _, v in tree}))
    assert set(tree) <= {(r.u, r.v) for r in groupsplit.relation_edges(df).collect()} and sorted(sorted(c) for c in by_hand) == sorted(sorted(i for i in roots if roots[i] == r) for r in set(roots.values()))
    dealt = {r.id: r.split for r in groupsplit.assign_splits(df).collect()}
    assert all(len({dealt[i] for i in c}) == 1 for c in by_hand) and set(dealt) == {i for i, *_ in data if i}
    assert groupsplit.tied_across_splits(df.limit(0)).count() == groupsplit.assign_splits(df.limit(0)).count() == 0


def test_assigned_shares(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("g"), (F.col("id") / 3).cast("int")).alias("group"), F.lit(None).cast("string").alias("parent"))
    n = {r.split: r["count"] for r in groupsplit.assign_splits(df).groupBy("split").count().collect()}
    assert abs(n["train"] - 2400) < 60 and abs(n["val"] - 300) < 40 and abs(n["test"] - 300) < 40


def test_large_components_go_where_rows_are_lacking(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 300, "a").when(F.col("id") < 600, "b").when(F.col("id") < 650, "c").alias("group"), F.lit(None).cast("string").alias("parent"))
    done = groupsplit.assign_splits(df, (0.3, 0.3, 0.4)).join(df.select("id", "group"), "id")
    assert {r.group: r.split for r in done.where("group is not null").select("group", "split").distinct().collect()} == {"a": "test", "b": "train", "c": "val"}
    n = {r.split: r["count"] for r in done.groupBy("split").count().collect()}
    assert abs(n["train"] - 300) < 20 and abs(n["val"] - 300) < 20 and abs(n["test"] - 400) < 20


# ---- p8 ----
def test_best_fill_is_the_best():
    rng = random.Random(8)
    for _ in range(40):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room, lengths = rng.randrange(0, 60), sorted(counts)
        reach = {0}
        for length, n in counts.items():
            reach = {x + k * length for x in reach for k in range(n + 1)}
        fill = packing.best_fill(lengths, counts, room)
        assert sum(k * v for k, v in fill.items()) == max(x for x in reach if x <= room) and all(v <= counts[k] for k, v in fill.items())


def test_containers_hold_everything_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_BUCKET", 50)
    rng = random.Random(1)
    items = [(i, rng.choice([1, 7, 7, 7, 64, rng.randrange(1, 400)])) for i in range(400)] + [(900, 0), (901, 64), (902, 640), (903, 1000)]
    out = packing.containers(spark.createDataFrame(items, "doc_id long, n_tokens long"), [("a", 64), ("b", 256)]).collect()
    for pack, capacity in (("a", 64), ("b", 256)):
        fill, parts = collections.Counter(), collections.defaultdict(list)
        for r in out:
            if r.pack_id == pack:
                fill[r.container_id] += r.token_end - r.token_start
                parts[r.doc_id].append((r.token_start, r.token_end))
        assert max(fill.values()) <= capacity
        for doc, n in items:
            p = sorted(parts[doc])
            assert [x for a, b in p for x in (a, b)] == ([x for k in range(0, n, capacity) for x in (k, min(n, k + capacity))] if n else [])
        assert sum(fill.values()) / (len(fill) * capacity) > 0.97
    large = packing.containers(spark.createDataFrame([(i, n) for i, n in enumerate([1_000, 290_000, 300_000, 10_000, 300_001, 7])], "doc_id long, n_tokens long"), [(f"p{i}", 300_000 * (i % 2 + 1)) for i in range(40)])
    fill = large.groupBy("pack_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n")).collect()
    assert all(r.n <= 300_000 * (int(r.pack_id[1:]) % 2 + 1) for r in fill) and sum(r.n for r in fill) == 40 * 901_008
    assert packing.containers(spark.createDataFrame([], "doc_id long, n_tokens long"), [("a", 64)]).count() == 0
    with pytest.raises(ValueError):
        packing.containers(spark.createDataFrame(items, "doc_id long, n_tokens long"), [("a", 0)])


# ---- p9 ----
def test_rounding_keeps_mass_and_probability():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 300).astype(float)
    total = np.zeros(300)
    for k in range(300):
        p, held = mixing.round_pairs(np.full(300, 0.3), size, np.random.default_rng(k))
        assert (p * size).sum() == pytest.approx(0.3 * size.sum(), rel=1e-6) and ((p == 0) | (p == 1)).sum() >= 299
        total += p
    assert abs(total.mean() / 300 - 0.3) < 0.01 and total.min() > 40


def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = [(i, "abc"[i % 3], 10 + i % 40) for i in range(600)] + [(1000, None, 50), (1001, "a", 0)]
    targets = [("m", "a", 0.5, 2, 1.0), ("m", "b", 0.2, 4, 1.0), ("m", "c", 0.1, 1, 1.0), ("m", "absent", 0.2, 3, 1.0), ("big", "a", 1.0, 2, 1.0)]
    df, t = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int, total_factor double")
    most = 50
    for keep in ("size", "shares"):
        chosen, goals = mixing.mixed(df, t, keep)
        report = {(r.mix_id, r.source): r for r in mixing.share_report(chosen, goals).collect()}
        assert all(abs(r.actual_tokens - r.goal_tokens) <= most for r in report.values())
        assert report["m", "absent"].actual_tokens == 0 and report["m", "absent"].short and report["big", "a"].short
        total = sum(n for _, _, n in docs)
        m = [report["m", x] for x in "abc"]
        if keep == "size":  # the absent source's tokens come from the others, by their shares
            assert abs(m[0].mix_tokens - total) <= 3 * most and m[2].goal_tokens == pytest.approx(total * 0.1 / 0.8)
        assert all(r.goal_share == pytest.approx(r.target_share / 0.8) and abs(r.actual_share - r.goal_share) * r.mix_tokens <= 3 * most for r in m)
        caps = {(m, s): r for m, s, _, r, _ in targets}
        seen = chosen.collect()
        assert all(1 <= r.repeats <= caps[r.mix_id, r.source] for r in seen) and len({(r.mix_id, r.doc_id) for r in seen}) == len(seen)
        assert sorted(map(tuple, mixing.mixed(df, t, keep)[0].collect())) == sorted(map(tuple, seen))
        reached = collections.Counter()
        for r in seen:
            reached[r.mix_id, r.source] += r.n_tokens * r.repeats
        assert all(reached[k] == r.actual_tokens for k, r in report.items())
    assert mixing.mixed(df.limit(0), t)[0].count() == 0
    odd = spark.createDataFrame([("m", "a", None, None, None), (None, "a", 1.0, 1, 1.0), ("m", "b", 0.5, None, None), ("m", "b", 0.5, 2, 1.0)], t.schema)
    chosen, goals = mixing.mixed(df, odd)
    assert {(r.source, r.target_share, r.max_repeats) for r in goals.collect()} == {("a", 0.0, 1), ("b", 1.0, 1)} and {r.source for r in chosen.collect()} == {"b"}


def test_goals_of_a_mix():
    assert mixing.aimed([(0.5, 1000), (0.3, 10), (0.2, 1000), (0.0, 9), (0.1, 0)], 100, "size") == pytest.approx([90 * 5 / 7, 10, 90 * 2 / 7, 0, 0])
    assert mixing.aimed([(0.5, 1000), (0.3, 10), (0.2, 1000)], 100, "shares") == pytest.approx([50 / 3, 10, 20 / 3])
    assert mixing.aimed([(0.5, 3), (0.5, 4)], 100, "size") == [3, 4] and mixing.aimed([], 5, "size") == []


# ---- p10 ----
SENTENCES = "The mill by the river was closed for the winter and nobody had seen the miller since. They kept the ledgers of the parish in a dry room above the hall until the roof was mended. "
EN = frozenset("the by was for and had since of in a they until above it is to".split())


def test_spam_pages(spark):
    rng = random.Random(2)
    story = " ".join(f"The {rng.choice(WORDS)} by the {rng.choice(WORDS)} was {rng.choice(WORDS)} for the {rng.choice(WORDS)} and had {rng.choice(WORDS)} since." for _ in range(12))
    stuffed = " ".join(rng.choice(["cheap boots", "buy boots", "boots sale", "boots"]) for _ in range(200))
    links = "\n".join(f"Cheap {rng.choice(WORDS)} {rng.choice(WORDS)} - http://{rng.choice(WORDS)}-shop.example/p?id={rng.randrange(999)}" for _ in range(20))
    tags = " ".join(f"#{rng.choice(WORDS).title()}{rng.choice(WORDS).title()}" for _ in range(60))
    table = "\n".join(f"{rng.choice(WORDS)}\t" + "\t".join(str(rng.randrange(1000)) for _ in range(5)) for _ in range(20))
    verse = "\n".join(["The river is wide and the boat is in the bay.", "Oh row it to the mill and row it to the town."] * 8)
    pages = {1: story, 2: stuffed, 3: links, 4: tags, 5: table, 6: verse, 7: story + "\n\n" + links[:300], 8: story[:300] + "\n" + stuffed, 9: None, 10: " ", 11: "ok", 12: ". ".join(["Buy boots", "Cheap boots sale", "Boots online"] * 40) + "."}
    df = spark.createDataFrame(list((k, "en", v) for k, v in pages.items()), "doc_id long, lang string, text string")
    out = {r.doc_id: r for r in spam.judged_pages(df, EN).collect()}
    assert {k for k, r in out.items() if r.is_spam} == {2, 3, 4, 8, 12}
    assert 9 not in out and 10 not in out and spam.judged_pages(df.limit(0), EN).count() == 0


def test_lists_without_spam_stay(spark):
    rng = random.Random(6)
    names = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)).title() + rng.choice(["stead", "wick", "low", "by"])
    times = "\n".join(f"{rng.randrange(24):02d}:{rng.randrange(60):02d}  {names()}  platform {rng.randrange(9)}" for _ in range(30))
    food = "\n".join(f"{rng.randrange(10, 990)} g {rng.choice(WORDS)} {rng.choice(['flour', 'butter', 'seeds', 'oil', 'peel'])}" for _ in range(12))
    terms = "\n".join(f"{names()}: the {rng.choice(WORDS)} by the {rng.choice(WORDS)} that was kept for the {rng.choice(WORDS)}." for _ in range(12))
    products = "\n".join(f"{rng.choice(WORDS)} {rng.choice(WORDS)} / {rng.choice(['new', 'sale'])} / {rng.randrange(99)} cm / SKU {rng.choice('ABC') * 3}-{rng.randrange(999)} / in stock" for _ in range(20))
    crumbs = "\n".join(f"{names()} » {names()} {rng.choice(WORDS)} » {names()}" for _ in range(20))
    pages = {1: times, 2: food, 3: terms, 4: products, 5: crumbs, 6: "Page not found"}
    clause = lambda: " ".join(w for _ in range(rng.randrange(4, 8)) for w in [rng.choice(sorted(EN)), *rng.choice([[], [names()], [rng.choice(WORDS)]])])
    story = lambda: " ".join(f"{clause()}, {clause()}." for _ in range(9))
    pages |= {100 + i: story() for i in range(80)}  # the prose the ratios are held against
    out = {r.doc_id: r.is_spam for r in spam.judged_pages(spark.createDataFrame([(k, "en", v) for k, v in pages.items()], "doc_id long, lang string, text string"), EN).collect()}
    assert not any(out.pop(100 + i) for i in range(80))
    assert out == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_blocks_keep_all_characters():
    text = "x" * 2500 + "\nshort\n\n" + "word " * 500 + "\n\n".join(f"line {i}" for i in range(400))
    kept = "".join(spam.blocks(text))
    squeezed = lambda x: sorted(re.sub(r"\s", "", x))
    assert squeezed(kept) == squeezed(text) and all(len(b) <= 1300 for b in spam.blocks(text))
    code, n = spam.coded("The #BigOak at www.oak-x12.test/a 12:30, 45 of it. Not the end", spam.Codes(frozenset(["the", "at", "of", "it"])))
    assert (code, n) == ("the #\x01 at \x01.\x01-\x019.\x01/\x01 12:30, 45 of it. \x01 the \x01", 13) and spam.sentence_ends(code) == 1
