"""Windows and spans, mining, robustness, construction, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.operators import construction, evaluation, mining, robustness, scoring, spans
from siltstone.plans.corpus import _tokens
from siltstone.plans.measures import feedback_events
from siltstone.plans.registry import query
from siltstone.plans.selection import _ex, examples
from siltstone.runtime import cut, numbered, table
from siltstone.sources import readers
from siltstone.streaming import streams

_sp = "(select distinct doc_id, text, spans, length(text) as n from raw_examples where text is not null and spans is not null)"
_rows = f"(select doc_id, n, unnest(spans).start_char as a, unnest(spans).end_char as b, unnest(spans).label as label from {_sp})"


def spanned(spark, d):
    return table(spark, d, "raw_examples").where("text is not null and spans is not null").select("doc_id", "text", "spans", F.length("text").alias("n")).dropDuplicates(["doc_id"])


@query(f"select doc_id, i * 384 as \"start\", least(i * 384 + 512, t) as \"end\" from (select doc_id, t, unnest(range(0, case when t <= 0 then 0 when t <= 512 then 1 else ceil((t - 512) / 384.0)::int + 1 end)) as i from (select doc_id, {_tokens} as t from documents where text is not null))")
def span_windows(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(spans.windows(T.token_count(F.col("text")))).alias("w"))
    return w.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


@query(f"with s as (select doc_id, n, a, b, row_number() over (partition by doc_id order by a, b) as k, lead(a) over (partition by doc_id order by a, b) as nx, count(*) over (partition by doc_id) as m from {_rows}) select doc_id, case when bool_or(k = 1 and a <> 0) then 'bad_start' when bool_or(nx is not null and nx <> b) then 'gap_or_overlap' when bool_or(k = m and b <> n) then 'bad_end' end as fault from s group by doc_id union all select doc_id, 'no_spans' from {_sp} where len(spans) = 0")
def span_tiling_faults(spark, d):
    return spanned(spark, d).select("doc_id", spans.tiling_fault(F.col("spans"), F.col("n")).alias("fault"))


@query(f"select doc_id, round(case when n = 0 then 0.0 else coalesce(list_sum(list_transform(list_filter(spans, lambda s: s.label <> 'human'), lambda s: s.end_char - s.start_char)), 0) / n::double end, 8) as fraction from {_sp}")
def span_marked_fraction(spark, d):
    return spanned(spark, d).select("doc_id", F.round(spans.marked_fraction(F.col("spans"), F.col("n")), 8).alias("fraction"))


@query(f"with s as (select doc_id, a, b, label, case when lag(b) over w = a and lag(label) over w = label then 0 else 1 end as new from {_rows} window w as (partition by doc_id order by a, b)), i as (select *, sum(new) over (partition by doc_id order by a, b) as island from s) select doc_id, min(a) as start_char, arg_max(b, a::bigint * 1000000 + b) as end_char, min(label) as label from i group by doc_id, island")
def span_merged(spark, d):
    rows = spanned(spark, d).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    return spans.merge_adjacent(rows, "doc_id")


@query("select doc_id, label, count(*) as n, sum(end_char - start_char) as chars from (select doc_id, unnest(spans).label as label, unnest(spans).end_char as end_char, unnest(spans).start_char as start_char from (select distinct doc_id, spans from raw_examples where spans is not null and text is not null)) group by all")
def span_totals(spark, d):
    rows = spanned(spark, d).select("doc_id", F.explode("spans").alias("s"))
    return rows.groupBy("doc_id", F.col("s.label").alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("s.end_char") - F.col("s.start_char")).alias("chars"))


def _aligned(spark, d):
    """(doc_id, offsets, labels) of every text with spans."""
    return spanned(spark, d).where(F.size("spans") > 0).select("doc_id", spans.token_labels("text", "spans").alias("t")).select("doc_id", "t.*")


# words and what lies between, in turn: running lengths give the offsets
_pieces = f"(select doc_id, spans, i, s, sum(length(s)) over (partition by doc_id order by i) as e from (select doc_id, spans, unnest(p) as s, generate_subscripts(p, 1) as i from (select distinct on (doc_id) doc_id, spans, regexp_extract_all(text, '[{T.WORD_CHAR}]+|[^{T.WORD_CHAR}]+') as p from raw_examples where text is not null and len(spans) > 0)))"
_ids = "case label when 'human' then 0 when 'ai_assisted' then 1 when 'ai_generated' then 2 end"
_labelled = f"""(with w as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, e - length(s) as a, e as b from {_pieces} where regexp_matches(s, '^[{T.WORD_CHAR}]')),
sp as (select distinct doc_id, s.start_char as sa, s.end_char as sb, s.label from (select doc_id, unnest(spans) as s from (select distinct doc_id, spans from raw_examples where text is not null and len(spans) > 0))),
best as (select doc_id, pos, label from (select w.doc_id, pos, label, row_number() over (partition by w.doc_id, pos order by least(b, sb) - greatest(a, sa) desc, sa, sb) as r from w join sp on w.doc_id = sp.doc_id and sa < b and least(b, sb) > greatest(a, sa)) where r = 1),
ends as (select doc_id, arg_min(label, sa::bigint * 10000000 + sb) as f, arg_max(label, sb::bigint * 10000000 - sa) as l, max(sb) as le from sp group by doc_id)
select w.doc_id, pos::int as pos, a, b, {_ids.replace('label', 'coalesce(best.label, case when a >= le then l else f end)')} as label_id from w left join best using (doc_id, pos) join ends using (doc_id))"""


@query(f"select doc_id, pos, label_id from {_labelled}")
def span_token_labels(spark, d):
    return _aligned(spark, d).select("doc_id", F.posexplode("labels").alias("pos", "label_id"))


@query(f"with t as (select doc_id, pos, label_id, case when lag(label_id) over (partition by doc_id order by pos) = label_id then 0 else 1 end as new from {_labelled}), i as (select *, sum(new) over (partition by doc_id order by pos) as island from t) select doc_id, min(pos) as \"start\", max(pos) + 1 as \"end\", min(label_id) as label from i where label_id > 0 group by doc_id, island")
def span_token_segments(spark, d):
    return spans.segments(span_token_labels(spark, d).withColumnRenamed("label_id", "label"), "doc_id", "label")


@query(f"""with t as (select * from {_labelled}), n as (select doc_id, count(*) as n from t group by doc_id), w as (select doc_id, i as win, i * 96 as ws, least(i * 96 + 128, n) as we from (select doc_id, n, unnest(range(0, case when n <= 128 then 1 else ceil((n - 128) / 96.0)::int + 1 end)) as i from n)),
g as (select doc_id, win, ws, we, min(a) as cs, max(b) as ce, count(*) filter (label_id > 0) / count(*)::double as f from w join t using (doc_id) where pos >= ws and pos < we group by doc_id, win, ws, we)
select doc_id, win::int as "window", ws as token_start, we as token_end, cs as char_start, ce as char_end, round(f, 8) as fraction, (f >= 0.5)::int as label from g""")
def span_windowed_examples(spark, d):
    """Windows of 128 words, 96 apart, each labelled by its own share of words that aren't human."""
    w = scoring.windowed_examples(_aligned(spark, d), 128, 96)
    return w.withColumn("fraction", F.round("fraction", 8))


_tk = "(select vec_id as k, i as pos, ((vec_id + i // 5) % 4) - 1 as l from (select vec_id, unnest(range(60)) as i from embeddings))"


def _labels(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("pos"))
    code = F.pmod(F.col("k") + F.floor(F.col("pos") / 5), F.lit(4)) - 1
    return rows.select("k", "pos", F.when(code < 0, spans.IGNORE).otherwise(code).cast("int").alias("label"))


@query(f"with t as (select k, pos, l, case when lag(l) over (partition by k order by pos) = l then 0 else 1 end as new from {_tk}), i as (select *, sum(new) over (partition by k order by pos) as island from t) select k, min(pos) as \"start\", max(pos) + 1 as \"end\", min(l) as label from i where l > 0 group by k, island")
def span_label_runs(spark, d):
    return spans.segments(_labels(spark, d), "k", "label")


@query(f"select k, pos from (select k, pos, l, lag(l) over (partition by k order by pos) as p from {_tk} where l >= 0) where p <> l")
def span_label_boundaries(spark, d):
    return spans.boundaries(_labels(spark, d), "k", "label")


@query(f"select k, round(count(*) filter (l > 0) / count(*) filter (l >= 0)::double, 8) as fraction from {_tk} group by k")
def span_label_fraction(spark, d):
    return spans.label_fraction(_labels(spark, d), "k", "label").select("k", F.round("fraction", 8).alias("fraction"))


@query("select l_orderkey, round(avg(s), 12) as mean, round(sum(s * w) / sum(w), 12) as weighted, round(max(s), 12) as top from (select l_orderkey, l_discount as s, l_quantity as w from lineitem) group by l_orderkey")
def window_score_aggregation(spark, d):
    """Window scores to document scores: mean, weighted mean, maximum."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("s"), F.col("l_quantity").alias("w"))
    r = lambda c: F.round(c, 12)
    return rows.groupBy("l_orderkey").agg(r(F.avg("s")).alias("mean"), r(F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("weighted"), r(F.max("s")).alias("top"))


@query(
    """with recursive q as (select l_orderkey, l_linenumber as pos, l_quantity::bigint as n, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as i from lineitem),
f as (select l_orderkey, pos, n, i, 0 as batch, case when n > 32 then 0 else n end as fill from q where i = 1
union all select q.l_orderkey, q.pos, q.n, q.i, batch + (f.n > 32 or (fill > 0 and (q.n > 32 or fill + q.n > 32)))::int, case when q.n > 32 then 0 when fill + q.n > 32 then q.n else fill + q.n end from f join q on q.l_orderkey = f.l_orderkey and q.i = f.i + 1)
select l_orderkey, pos, n, batch from f"""
)
def batch_packing(spark, d):
    """Line items of an order as requests of a queue, packed first in first out."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("long").alias("n"))
    return construction.packed_batches(rows, "l_orderkey", 32)


# ---- mining ----
_cf = "('0x' || substr(sha256(vec_id::varchar), 1, 8))::bigint / 4294967296.0::double"


def _failures(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"), (H.hex_number(F.sha2(F.col("vec_id").cast("string"), 256), 8) / 4294967296.0).alias("score"))


@query(f"select count(*) as scanned, count(*) filter (s >= 0.7) as errors, round(avg(case when s >= 0.7 then 1.0 else 0.0 end), 8) as error_rate, count(*) filter (s >= 0.8 and s < 0.9) as mined, count(*) filter (s >= 0.8 and s >= 0.9) as already_mined from (select vec_id, {_cf} as s from embeddings)")
def mine_scan_report(spark, d):
    f = _failures(spark, d)
    r = mining.scan_report(f, f.where("score >= 0.9"), 0.7, 0.8)
    return r.withColumn("error_rate", F.round("error_rate", 8))


@query(f"select vec_id as doc_id, label as cluster from (select vec_id, label, {_cf} as s from embeddings) where s >= 0.8 and s < 0.9")
def mine_confident_errors(spark, d):
    f = _failures(spark, d)
    return mining.confident_errors(f, f.where("score >= 0.9"), 0.7, 0.8).select("doc_id", "cluster")


@query(f"select vec_id as doc_id, round(1 - s, 8) as confidence from (select vec_id, {_cf} as s from embeddings) where s <= 0.1")
def mine_missed_machine(spark, d):
    return mining.missed_machine(_failures(spark, d)).select("doc_id", F.round("confidence", 8).alias("confidence"))


@query(f"select cluster, size, round(mc, 8) as mean_confidence, round(size / (sum(size) over ())::double, 8) as share, ids as exemplar_ids from (select label as cluster, count(*) as size, avg({_cf}) as mc, array_to_string((list(vec_id order by {_cf} desc, vec_id))[1:5], ',') as ids from embeddings group by label)")
def mine_cluster_summary(spark, d):
    s = mining.cluster_summary(_failures(spark, d).withColumn("confidence", F.col("score")))
    return s.select("cluster", "size", F.round("mean_confidence", 8).alias("mean_confidence"), F.round("share", 8).alias("share"), F.array_join(F.transform("exemplar_ids", lambda x: x.cast("string")), ",").alias("exemplar_ids"))


@query("select cluster, value, n, rank from (select cluster, value, count(*) as n, row_number() over (partition by cluster order by count(*) desc, min(pos)) as rank from (select vec_id % 6 as cluster, (vec_id * 7 // 5 % 11)::varchar as value, vec_id as pos from embeddings) group by cluster, value) where rank <= 3")
def mine_top_values(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 6).alias("cluster"), (F.floor(F.col("vec_id") * 7 / 5) % 11).cast("string").alias("domain"), F.col("vec_id").alias("pos"))
    return mining.top_values(rows, "domain")


@query("select label as cluster, count(*) / (select count(*) from embeddings)::double > 0.09 as large from embeddings group by label")
def mine_quality_warnings(spark, d):
    s = mining.cluster_summary(_failures(spark, d).withColumn("confidence", F.col("score")))
    w = mining.quality_warnings(s, 0.09).select("cluster", F.lit(True).alias("large"))
    return s.select("cluster").join(w, "cluster", "left").select("cluster", F.coalesce("large", F.lit(False)).alias("large"))


@query(
    """with v as (select vec_id, label as c, embedding::double[] as e from embeddings), p as (select x.vec_id, x.c as own, y.c as other, sum(list_distance(x.e, y.e)) as d, count(*) as n from v x, v y group by all),
m as (select vec_id, own, max(case when own = other and n > 1 then d / (n - 1) end) as a, min(case when own <> other then d / n end) as b from p group by vec_id, own) select round(avg((b - a) / greatest(a, b)), 8) as silhouette, count(*) as n from m where a is not null and b is not null"""
)
def mine_silhouette(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
    return mining.silhouette(v).withColumn("silhouette", F.round("silhouette", 8))


@query()
def mine_kmeans(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return mining.kmeans(v, 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def mine_hashed_embedding(spark, d):
    from siltstone.functions.python_udfs import embed

    e = table(spark, d, "documents").where("text is not null").select("doc_id", embed("text").alias("v"))
    return e.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_norm"))


# ---- robustness and construction ----
@query()
def robust_attacks(spark, d):
    """What every offline attack does to every benchmark text: changed at all, and still there after normalising."""
    docs = table(spark, d, "benchmark_docs").select("doc_id", "text")
    a = robustness.attacked(docs)
    return a.groupBy("attack", "severity").agg(F.count("*").alias("n"), F.count_if("noop").alias("n_noop"), F.count_if("survives").alias("n_survive"))


@query()
def robust_delta(spark, d):
    """Miss rates under attack against the clean texts, scored by a text statistic (the share of long words)."""
    docs = table(spark, d, "benchmark_docs").where("label = 1").select("doc_id", "text")
    score = lambda c: F.least(F.lit(1.0), T.mean_word_length(c) / 8)
    clean = docs.select("doc_id", score(F.col("text")).alias("clean_score"))
    a = cut(robustness.attacked(docs)).withColumn("score", score(F.col("text")))
    return robustness.delta_table(a.join(clean, "doc_id"), 0.62)


@query()
def robust_conditions(spark, d):
    """Misses under attack with four ways to prepare a text, each against the clean texts prepared alike."""
    docs = table(spark, d, "benchmark_docs").where("label = 1 and text is not null").select("doc_id", "text")
    names = list(robustness.CONDITIONS)
    score = F.least(F.lit(1.0), T.mean_word_length(F.col("text")) / 8)
    a = robustness.attacked(docs, ["homoglyph_substitute", "case_perturb", "whitespace_perturb"]).where("not noop and valid")
    under = robustness.under_conditions(a.select("attack", "severity", "text"), names).select("attack", "severity", "condition", score.alias("score"))
    clean = robustness.under_conditions(docs.select("text"), names).select("condition", score.alias("score"))
    return robustness.condition_table(under, clean, 0.62)


@query()
def robust_condition_cost(spark, d):
    """What the preparations do to human texts: their scores' median and upper percentiles."""
    from siltstone.operators import metrics

    docs = table(spark, d, "benchmark_docs").where("label = 0 and text is not null").select("text")
    under = robustness.under_conditions(docs, list(robustness.CONDITIONS)).select("condition", F.lit(0).alias("y_true"), F.least(F.lit(1.0), T.mean_word_length(F.col("text")) / 8).alias("score"))
    return metrics.condition_cost(under, 0.62, ["condition"])


def _mirrors(spark, d):
    e = examples(spark, d).where("text is not null")
    human = e.select(F.col("doc_id").alias("human_id"), F.col("text").alias("human_text"))
    return e.where("source_human_id is not null").select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text"), F.col("source_human_id").alias("human_id")).join(human, "human_id")


@query()
def build_splices(spark, d):
    s = construction.spliced(_mirrors(spark, d))
    return s.select("doc_id", "reason", F.length("text").alias("n"), F.size("spans").alias("n_spans"), spans.tiling_fault(F.col("spans"), F.length("text")).alias("fault"))


@query()
def build_edit_spans(spark, d):
    pairs = _mirrors(spark, d).select("human_id", "human_text", F.col("other_text").alias("edited_text"))
    return construction.edited(pairs).select("doc_id", F.round("fraction", 6).alias("fraction"), "kept", F.size("spans").alias("n_spans"))


@query()
def build_generated(spark, d):
    """Counterparts of the human rows by the offline stand-in model: outcomes by family and attempt."""
    e = examples(spark, d).where("text is not null and label = 0")
    key = F.col("doc_id")
    specs = e.select("doc_id", H.pick(["basalt", "ember"], H.digest_number(key, "family")).alias("family"), F.concat(F.lit("Write about "), F.coalesce("domain", F.lit("anything"))).alias("prompt"), T.token_count(F.col("text")).alias("target_words"), F.pmod(H.digest_number(key, "seed"), F.lit(2**31)).alias("seed"))
    g = construction.generated(specs, construction.pretend)
    return g.groupBy("family", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("attempt").alias("retries"))


# ---- benchmark parsers ----
@query("select doc_id, coalesce(nullif(group_id, ''), doc_id) as group_id, case when model = 'human' then 0 else 1 end as label, coalesce(nullif(lower(coalesce(domain, '')), ''), 'unknown') as domain, coalesce(nullif(attack, ''), 'none') as attack from benchmark_docs where lower(coalesce(domain, '')) not in ('code', 'czech', 'german')")
def parse_grouped_attacks(spark, d):
    b = table(spark, d, "benchmark_docs")
    rows = b.select(F.col("doc_id").alias("id"), F.lit("").alias("adv_source_id"), F.col("group_id").alias("source_id"), "model", F.lit("").alias("decoding"), F.lit("").alias("repetition_penalty"), "attack", "domain", F.lit("").alias("title"), F.lit("").alias("prompt"), F.col("text").alias("generation"))
    return evaluation.parse_raid(rows).select("doc_id", "group_id", "label", "domain", "attack")


@query(f"select 'mage_' || (row_number() over (order by doc_id) - 1) as doc_id, case when label = 0 then 1 else 0 end as label, coalesce(source, 'unknown') as model from {_ex} where text is not null")
def parse_inverted_labels(spark, d):
    from pyspark.sql import Window

    e = examples(spark, d).where("text is not null").select("text", "label", F.col("source").alias("src"), "doc_id")
    e = numbered(e, "n", "doc_id").drop("doc_id")
    return evaluation.parse_mage(e, "n").select("doc_id", "label", "model")


@query("select 'hc3_q' || g || '_' || kind || '_' || (row_number() over (partition by g, kind order by doc_id) - 1) as doc_id, 'hc3_q' || g as group_id, label from (select group_id as g, doc_id, label, case when label = 0 then 'human' else 'chatgpt' end as kind, text from benchmark_docs where label is not null and group_id is not null and text is not null) where trim(text) <> ''")
def parse_answer_lists(spark, d):
    b = table(spark, d, "benchmark_docs").where("label is not null and group_id is not null and text is not null and trim(text) <> ''")
    answers = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.struct("doc_id", "text")))), lambda x: x["text"])
    rows = b.groupBy(F.col("group_id").alias("id")).agg(answers(0).alias("human_answers"), answers(1).alias("chatgpt_answers")).withColumn("question", F.lit("q")).withColumn("source", F.lit("s"))
    return evaluation.parse_hc3(rows).select("doc_id", "group_id", "label")


@query("select source_id, count(*) as n, count(extra['url']) as n_url, count(upstream_language.lang) as n_lang from raw_records where source_id in ('fw', 'fwe') and upstream_language.score >= 0.65 group by source_id")
def source_score_filter(spark, d):
    """A hosted corpus read with its language-score filter at the scan."""
    r = table(spark, d, "raw_records").where("source_id in ('fw', 'fwe')")
    rows = r.select("source_id", F.col("source_record_id").alias("id"), "text", F.col("upstream_language.lang").alias("language"), F.col("upstream_language.score").alias("language_score"), F.col("extra")["url"].alias("url"))
    out = readers.web_rows(rows.where("source_id = 'fw'"), "fw", 0.65).unionByName(readers.web_rows(rows.where("source_id = 'fwe'"), "fwe", 0.65))
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.count(F.col("extra")["url"]).alias("n_url"), F.count("upstream_language.lang").alias("n_lang"))


# ---- streams ----
@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, d):
    s = streams.tumbling_counts(streams.timed(streams.stream_table(spark, d, "events")), ["event_type"])
    return streams.drain(s, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select strftime(w, '%Y-%m-%d %H') as start, count(*) as n from (select unnest([date_trunc('hour', ts) - to_hours((extract(hour from ts) % 6)::int), date_trunc('hour', ts) - to_hours((extract(hour from ts) % 6)::int + 6)]) as w from events) group by all")
def stream_sliding(spark, d):
    s = streams.tumbling_counts(streams.timed(streams.stream_table(spark, d, "events")), [], "12 hours", "6 hours")
    return streams.drain(s, "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events), i as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from i group by user_id, k")
def stream_sessions(spark, d):
    s = streams.drain(streams.sessions(streams.timed(streams.stream_table(spark, d, "events")), "user_id", "6 hours"), "complete")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select count(distinct (user_id, event_type)) as n from events")
def stream_deduplicated(spark, d):
    s = streams.first_of_hash(streams.timed(streams.stream_table(spark, d, "events")).select("ts", "user_id", "event_type"), ["user_id", "event_type"])
    return streams.drain(s).agg(F.count("*").alias("n"))


@query()
def stream_feedback(spark, d):
    e = streams.stream_table(spark, d, "events")
    kind = F.col("event_type")
    to = F.when(kind == "click", "under_review").when(kind == "view", "verified").when(kind == "purchase", "rejected").otherwise("unverifiable")
    out = streams.drain(streams.feedback_machine(e.select(F.col("user_id").alias("item"), F.col("event_id").alias("pos"), to.alias("to"))), "update")
    return out.groupBy("item").agg(F.max_by("state", "n_illegal").alias("state"), F.max("n_illegal").alias("n_illegal"))


@query()
def stream_feedback_agrees(spark, d):
    """Items whose streamed state differs from the batch fold's: none."""
    batch = evaluation.transition_faults(feedback_events(spark, d)).select("item", F.col("r.state").alias("b"))
    return stream_feedback(spark, d).join(batch, "item", "full").where(~F.col("state").eqNullSafe(F.col("b"))).select("item")
