"""Problem 6: the language of each record and of each mixed-language segment.

Script ranges narrow the candidates of a word: a word with letters of a script other than Latin is of the one language
that script stands for, or of none where it stands for several (``und-`` and the script's code). Latin words may be of any of the six
languages: each has a score per language, the log probability from word counts or, for words not counted, from its letter
triples. The Viterbi path over all Latin words and numbers of a record, with a penalty for switching (lower at a paragraph's start), labels
spans. A paragraph is of the language of most of its words; Latin text of which less than ``LEAST_FIT`` of the words go best with
that language is of none of the six (``und``).

The word scores are fitted on at most ``SAMPLE`` labelled records, those with the smallest hash of
their id, and refitted once on their paragraphs as the first fit labels them, as labels may be wrong. Words are counted on the
executors; what reaches the driver is bounded by ``MOST_WORDS`` words and ``TRIPLES`` buckets, whatever the data's size.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.quality import breaks_policy, ends_sentence, statistics_of
from siltstone.llm.textwork import batches, mix, words
from siltstone.runtime import cut, spread

#: The languages told apart, and what else a label may be called (fixed values).
LANGUAGES = ["de", "en", "es", "fr", "it", "pt"]
SPELLINGS = {
    "de": ["deu", "ger", "german"],
    "en": ["eng", "english"],
    "es": ["spa", "spanish", "castilian"],
    "fr": ["fra", "fre", "french"],
    "it": ["ita", "italian"],
    "pt": ["por", "portuguese"],
}
NO_LABEL = ["", "und", "unknown", "xx"]

SAMPLE = 6000
MOST_WORDS = 60_000
TRIPLES = 1 << 14
SWITCH, SWITCH_PARAGRAPH = 4.0, 0.5
FLOOR = -4.0
LEAST_WORDS = 12
LEAST_FIT = 0.3
LONG, BLOCK = 8192, 512
#: First code points of the scripts told apart (a script runs up to the next entry; "" is Latin and whatever is no letter), and
#: the language a script stands for (fixed values).
SCRIPT_STARTS = [
    (0, ""), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Hebr"), (0x600, "Arab"), (0x700, "Zyyy"), (0x900, "Deva"), (0x980, "Beng"), (0xA00, "Zyyy"), (0xB80, "Taml"), (0xC00, "Zyyy"), (0xE00, "Thai"), (0xE80, "Zyyy"),
    (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Zyyy"), (0x1C90, "Geor"), (0x1CC0, "Zyyy"), (0x1D00, ""), (0x1F00, "Grek"), (0x2000, ""), (0x2DE0, "Cyrl"), (0x2E00, ""), (0x2E80, "Hani"), (0x3040, "Kana"), (0x3100, "Zyyy"), (0x3130, "Hang"),
    (0x3190, "Zyyy"), (0x31F0, "Kana"), (0x3200, "Zyyy"), (0x3400, "Hani"), (0xA000, "Zyyy"), (0xA640, "Cyrl"), (0xA6A0, "Zyyy"), (0xA720, ""), (0xA800, "Zyyy"), (0xAC00, "Hang"), (0xD800, "Zyyy"), (0xF900, "Hani"), (0xFB00, ""), (0xFB1D, "Hebr"),
    (0xFB50, "Arab"), (0xFE00, "Zyyy"), (0xFE70, "Arab"), (0xFF00, ""), (0xFF66, "Kana"), (0xFFA0, "Hang"), (0xFFE0, "Zyyy"), (0x20000, "Hani"), (0x32000, "Zyyy"),
]
SCRIPT_LANGUAGE = {"Grek": "el", "Armn": "hy", "Hebr": "he", "Beng": "bn", "Taml": "ta", "Thai": "th", "Geor": "ka", "Hang": "ko", "Kana": "ja", "Hani": "zh"}
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS if name})

BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")
_STARTS = np.array([at for at, _ in SCRIPT_STARTS])
_NUMBERS = np.array([1 + SCRIPTS.index(name) if name else 0 for _, name in SCRIPT_STARTS])
#: What paragraphs may be called: the languages, then what each script stands for.
NAMES = LANGUAGES + [SCRIPT_LANGUAGE.get(name, f"und-{name}") for name in SCRIPTS]


def label_language(label: Column) -> Column:
    """The language a label stands for; null if it stands for none; other names stay as they are."""
    name = F.lower(F.trim(label))
    base = F.regexp_extract(name, "^[^-_]*", 0)
    out = F.when(name.isNull() | name.isin(NO_LABEL), None)
    for lang, names in SPELLINGS.items():
        out = out.when(base.isin(lang, *names), lang)
    return out.otherwise(name)


def paragraphs(text: str) -> list[str]:
    return BLANK_LINES.split(text.replace("\r\n", "\n").strip())


def spelled(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between ^ and $ in a row, where each word's begin, and how many it has."""
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 2
    points = np.frombuffer("".join(f"^{w}$" for w in tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return points, np.cumsum(lengths) - lengths, lengths


def triples_of(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter triples of words in a row, where each word's begin, and how many it has (one at least)."""
    n = lengths - 2
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    code = points[at] + (points[at + 1] << 21) + (points[at + 2] << 42)
    return (mix(code.view(np.uint64)) % np.uint64(TRIPLES)).astype(np.int64), first, n


def scripts_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script number of each word: 0 for Latin letters and digits only, else the greatest of its letters'."""
    own = _NUMBERS[np.searchsorted(_STARTS, points, "right") - 1]
    return np.maximum.reduceat(own, starts) if len(starts) else np.zeros(0, dtype=np.int64)


class _Known(dict):
    """Word -> row; words not met before are listed and numbered on."""

    def __init__(self, index: dict[str, int], rows: int):
        super().__init__(index)
        self.rows, self.new = rows, []

    def __missing__(self, word: str) -> int:
        at = self[word] = self.rows + len(self.new)
        self.new.append(word)
        return at


class Scores:
    """The scores of a model's words and of those met on the way, for one task."""

    def __init__(self, model: "Model"):
        self.model = model
        self._reset()

    def _reset(self):
        self.known = _Known(self.model.index, len(self.model.table))
        self.table, self.script = self.model.table, np.zeros(len(self.model.table), dtype=np.int64)

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores and the words' script numbers."""
        if len(self.table) > len(self.model.table) + MOST_MET:
            self._reset()
        at = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.known.new:
            scores, script = self.model.unknown(self.known.new)
            self.table, self.script = np.concatenate((self.table, scores)), np.concatenate((self.script, script))
            self.known.rows, self.known.new = len(self.table), []
        return self.table[at], self.script[at]


class Model:
    """Scores of words per language."""

    def __init__(self, index: dict[str, int], table: np.ndarray, triples: np.ndarray):
        self.index, self.table, self.triples = index, table, triples

    def unknown(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and script numbers of uncounted words; those of other scripts and without a letter score 0 throughout."""
        points, starts, lengths = spelled(tokens)
        script = scripts_of(points, starts)
        buckets, first, n = triples_of(points, starts, lengths)
        score = np.add.reduceat(self.triples[buckets], first, axis=0) / n[:, None]
        score -= score.max(axis=1, keepdims=True)
        letter = (points > 0x39) & (points != 0x5E)  # neither a digit nor one of the two marks, which are $ and ^
        score[(script > 0) | ~np.logical_or.reduceat(letter, starts)] = 0.0
        return score.astype(np.float32), script


MOST_MET = 400_000


def _counted(make):
    """(label, text) batches as (lang, word, n); ``make()``, once a task, gives the function from a label's number and a text to (language number, words) pairs."""

    def scan(rows):
        label_of = make()
        for batch in rows:
            counts: dict[int, Counter] = {}
            for label, text in zip(*(c.to_pylist() for c in batch.columns)):
                for lang, tokens in label_of(LANGUAGES.index(label), text):
                    counts.setdefault(lang, Counter()).update(tokens)
            flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            cols = list(zip(*flat)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    return scan


def _triple_weights(common: dict[str, list[int]]):
    """(lang, word, n) batches as (bucket, lang, weight): each word's triples, up to five times, but for common words of the language, which the driver adds."""

    def scan(rows):
        sums = np.zeros((TRIPLES, len(LANGUAGES)))
        for batch in rows:
            langs, tokens, n = (c.to_pylist() for c in batch.columns)
            keep = [i for i, w in enumerate(tokens) if langs[i] not in common.get(w, ())]
            _add_triples(sums, [tokens[i] for i in keep], np.array([langs[i] for i in keep], dtype=np.int64), np.minimum(np.array([n[i] for i in keep], dtype=float), 5))
        bucket, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(lang, pa.int32()), pa.array(sums[bucket, lang])], ["bucket", "lang", "weight"])

    return scan


def _add_triples(sums: np.ndarray, tokens: list[str], langs: np.ndarray, weight: np.ndarray) -> None:
    if tokens:
        points, starts, lengths = spelled(tokens)
        buckets, _, n = triples_of(points, starts, lengths)
        latin = scripts_of(points, starts) == 0
        np.add.at(sums, (buckets, np.repeat(langs, n)), np.repeat(weight * latin, n))


def _model(counts: DataFrame, common: dict[str, list[int]]) -> Model:
    """Model from (lang, word, n) counts; ``common`` gives words that are known to be of some languages."""
    k = len(LANGUAGES)
    counts = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size = np.ones(k)
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        size[r["lang"]] += r["n"]
    for langs in common.values():
        size[langs] += 5
    absent = [lang for lang in range(k) if size[lang] == 1.0]  # no text and no common word: never the answer
    per = counts.groupBy("word").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(k)))
    top = per.where((F.col("total") >= 4) & ~F.col("word").rlike("^[0-9]+$")).orderBy(F.desc("total"), "word").limit(MOST_WORDS).collect()
    rates = {r["word"]: np.array([r[f"n{i}"] for i in range(k)], dtype=float) for r in top}
    rare = per.where(F.col("word").isin(sorted(set(common) - set(rates)))).collect() if common else []  # at most the common words
    rates |= {r["word"]: np.array([r[f"n{i}"] for i in range(k)], dtype=float) for r in rare}
    for word, langs in common.items():
        rates.setdefault(word, np.zeros(k))[langs] += 5
    vocabulary = sorted(rates)
    points, starts, _ = spelled(vocabulary)
    vocabulary = [w for w, script in zip(vocabulary, scripts_of(points, starts)) if not script]
    score = np.log((np.array([rates[w] for w in vocabulary]).reshape(len(vocabulary), k) + 0.3) / size * size.mean())
    if len(vocabulary):
        score[:, absent] = -np.inf
        score = np.maximum(score - score.max(axis=1, keepdims=True), FLOOR)
    buckets = np.full((TRIPLES, k), 0.5)
    weights = counts.select("lang", "word", "n").mapInArrow(_triple_weights(common), "bucket int, lang int, weight double").groupBy("bucket", "lang").agg(F.sum("weight").alias("w"))
    for r in weights.collect():  # at most TRIPLES times the languages
        buckets[r["bucket"], r["lang"]] += r["w"]
    own = [(w, lang) for w, langs in sorted(common.items()) for lang in langs]
    _add_triples(buckets, [w for w, _ in own], np.array([lang for _, lang in own], dtype=np.int64), np.full(len(own), 5.0))
    triples = np.log(buckets / buckets.sum(axis=0))
    triples[:, absent] = -np.inf
    triples = np.maximum(triples - triples.max(axis=1, keepdims=True), -2.0) * 0.5 if len(absent) < k else np.zeros((TRIPLES, k))
    return Model({w: i for i, w in enumerate(vocabulary)}, score.astype(np.float32), triples)


def fit(records: DataFrame, common: dict[str, str], sample: int = SAMPLE) -> Model:
    """Model from ``records`` (id, label, text), ``label`` being a language or null; the sample is the ``sample`` records of smallest hash (and those equal to the last)."""
    labelled = records.where(F.col("label").isin(LANGUAGES) & F.col("text").isNotNull() & F.col("id").isNotNull())
    place, whole = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), max(1, labelled.count())
    # a hash threshold leaves about the sample before the top is taken, so that tasks send little
    near = labelled.where(place < F.lit(int(min(1.0, 1.1 * sample / whole) * (1 << 40))))
    last = near.select(place.alias("place")).orderBy("place").limit(sample).agg(F.max("place")).first()[0]  # a top-k of numbers
    rows = labelled.where(place <= F.lit(last)).select("label", "text") if last is not None else labelled.select("label", "text").limit(0)
    rows = cut(spread(rows))
    number = {lang: i for i, lang in enumerate(LANGUAGES)}
    known = {w: [number[x] for x in langs.split() if x in number] for w, langs in common.items()}
    known = {w: langs for w, langs in known.items() if langs}
    schema = "lang int, word string, n long"
    first = records.sparkSession.sparkContext.broadcast(_model(rows.mapInArrow(_counted(lambda: lambda label, text: [(label, words(text))]), schema), known))

    def relabelled():
        scores = Scores(first.value)

        def label_of(_, text):
            for tokens in map(words, paragraphs(text)):
                if len(tokens) >= LEAST_WORDS:
                    yield int(scores.of(tokens)[0].sum(axis=0).argmax()), tokens

        return label_of

    return _model(rows.mapInArrow(_counted(relabelled), schema), known)


def _forward(scores, penalty, starts, sizes, value):
    """Values at the ends of chains (longest first) and where each step came from; ``value`` is what each state starts with."""
    k = scores.shape[1]
    place = np.cumsum(sizes) - sizes
    back = np.empty((int(sizes.sum()), k), dtype=np.uint8)
    own = np.arange(k, dtype=np.uint8)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # chains longer than t
    for t in range(int(sizes[0])):
        m = active[t]
        at = starts[:m] + t
        v = value[:m]
        best = v.argmax(axis=1)
        switch = (v[np.arange(m), best] - penalty[at])[:, None]
        take = v < switch
        back[place[:m] + t] = np.where(take, best[:, None].astype(np.uint8), own)
        value[:m] = np.where(take, switch, v) + scores[at]
    return value, back, place, active


def _backward(back, place, active, state):
    """The paths that end in ``state``, chain after chain."""
    path = np.empty(len(back), dtype=np.uint8)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = place[:m] + t
        path[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return path


def _long_path(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Best path of one long chain: each block of it from every state it may be entered in, side by side, then the blocks in turn."""
    n, k = scores.shape
    starts = np.arange(0, n, BLOCK)
    sizes = np.minimum(BLOCK, n - starts)
    value = np.tile(np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-1e9)), (len(starts), 1))
    value[:k] = 0  # the first block may start in any state
    value, back, place, active = _forward(scores, penalty, np.repeat(starts, k), np.repeat(sizes, k), value)
    ends = value.reshape(len(starts), k, k).astype(np.float64)
    total, entered = ends[0, 0], np.zeros((len(starts), k), dtype=np.int64)
    for b in range(1, len(starts)):
        whole = total[:, None] + ends[b]
        entered[b] = whole.argmax(axis=0)
        total = whole.max(axis=0)
    state = np.zeros(len(starts) * k, dtype=np.int64)
    chosen = np.zeros(len(starts), dtype=np.int64)
    last = int(total.argmax())
    for b in range(len(starts) - 1, -1, -1):
        chosen[b] = b * k + entered[b, last]
        state[chosen[b]] = last
        last = int(entered[b, last])
    path = _backward(back, place, active, state)
    return np.concatenate([path[place[c] : place[c] + size] for c, size in zip(chosen, sizes)])


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Best path of each chain (consecutive rows of ``scores``), all chains step by step together, long ones block by block."""
    path = np.empty(len(scores), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths > LONG):
        at = slice(int(starts[i]), int(starts[i] + lengths[i]))
        path[at] = _long_path(scores[at], penalty[at])
    order = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    order = order[np.argsort(-lengths[order], kind="stable")]
    if len(order):
        sizes = lengths[order]
        value, back, place, active = _forward(scores, penalty, starts[order], sizes, np.zeros((len(order), scores.shape[1]), dtype=np.float32))
        own = _backward(back, place, active, value.argmax(axis=1))
        path[np.repeat(starts[order] - place, sizes) + np.arange(len(own))] = own
    return path


def label_paragraphs(records: DataFrame, model: Model, policy: tuple[dict, dict] | None = None) -> DataFrame:
    """(id, label, para_no, lang, confidence, n_words, other_words, sentence_end) of each paragraph of ``records`` (id, label, text).

    ``lang`` is that of most words (ties: the six languages first, by name; ``und`` without letters or where Latin words don't go with it),
    ``confidence`` their share, for Latin words times the odds of the paragraph's summed scores; ``other_words`` counts words of other
    languages in it. Blank texts have no paragraphs. With ``policy`` (common words, limits by source) records that break their source's limits
    are left out; ``records`` has a column source then.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    k, every = len(LANGUAGES), len(NAMES)

    def wanted(source, text):
        if not text or not text.strip():
            return False
        return policy is None or not breaks_policy(policy[1].get(source), statistics_of(text, policy[0])[1])

    def scan(rows):
        known = Scores(shared.value)
        for batch in rows:
            texts, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in batches(texts, 3_000_000):
                tokens, rec, number, sizes, ends, lengths = [], [], [], [], [], []
                fresh = []  # words that start a paragraph
                for i in range(a, b):
                    if not wanted(sources[i], texts[i]):
                        continue
                    before = len(tokens)
                    for p_no, p in enumerate(paragraphs(texts[i])):
                        own = words(p)
                        rec.append(i)
                        number.append(p_no)
                        sizes.append(len(own))
                        ends.append(any(ends_sentence(x.strip()) for x in p.split("\n")))
                        if own:
                            fresh.append(len(tokens))
                        tokens += own
                    lengths.append(len(tokens) - before)
                if not rec:
                    continue
                scores, script = known.of(tokens)
                penalty = np.full(len(tokens), SWITCH, dtype=np.float32)
                penalty[fresh] = SWITCH_PARAGRAPH
                path = viterbi(scores, np.array(lengths, dtype=np.int64), penalty)
                state = np.where(script > 0, k - 1 + script, path)
                sizes = np.array(sizes)
                para = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(sizes))
                counts = np.bincount(para * every + state, minlength=len(sizes) * every).reshape(-1, every)
                sums = np.column_stack([np.bincount(para, scores[:, j], minlength=len(sizes)) for j in range(k)])
                scored = (scores != 0).any(axis=1)
                latin = np.bincount(para, scored, minlength=len(sizes))
                lang = counts.argmax(axis=1)
                best = np.minimum(lang, k - 1)
                fits = np.bincount(para, scored & (scores[np.arange(len(tokens)), best[para]] >= 0), minlength=len(sizes))
                tempered = (sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(sizes, 1))[:, None]
                odds = np.exp(tempered)
                odds /= odds.sum(axis=1, keepdims=True)
                share = counts[at, lang] / np.maximum(sizes, 1)
                own_script = lang >= k
                seen = own_script | ((latin > 0) & (fits >= LEAST_FIT * latin))
                confidence = np.where(seen, share * np.where(own_script, 1.0, odds[at, best]), 0.0)
                names = np.where(seen, np.array(NAMES, dtype=object)[lang], "und")
                own = pa.array(rec)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(number, pa.int64()), pa.array(names.tolist(), pa.string()), pa.array(confidence), pa.array(sizes, pa.int32()), pa.array(sizes - counts[at, lang], pa.int32()), pa.array(ends, pa.bool_())],
                    ["id", "label", "para_no", "lang", "confidence", "n_words", "other_words", "sentence_end"],
                )

    source = F.col("source") if policy is not None else F.lit(None).cast("string").alias("source")
    return records.where("text is not null").select("id", "label", "text", source).mapInArrow(scan, "id string, label string, para_no long, lang string, confidence double, n_words int, other_words int, sentence_end boolean")


def record_languages(labelled: DataFrame) -> DataFrame:
    """(id, lang, confidence, n_languages): the language of most words of each record, by its paragraphs."""
    per = labelled.dropDuplicates(["id", "para_no"]).groupBy("id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.col("n_words")).alias("c"))
    best = F.max_by(F.struct("lang", "c"), F.struct(F.col("n"), F.col("c")))
    return per.groupBy("id").agg(best.alias("b"), F.sum("n").alias("n"), F.count_if(F.expr("n > 0")).alias("n_languages")).select("id", F.col("b.lang").alias("lang"), F.coalesce(F.try_divide(F.col("b.c"), F.col("n")), F.lit(0.0)).alias("confidence"), "n_languages")


def mislabelled(labelled: DataFrame) -> DataFrame:
    """(id, para_no, lang) of the paragraphs whose language isn't the label's, with LEAST_WORDS words and a sentence end."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return labelled.where(wrong & F.col("lang").isin(LANGUAGES) & (F.col("n_words") >= LEAST_WORDS) & F.col("sentence_end")).select("id", "para_no", "lang").distinct()
