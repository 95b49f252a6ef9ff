"""Training rows, document scores, crawl plans, reports over results and image metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.operators import evaluation, mining, reports, scoring
from siltstone.operators.spans import WORD_RUN
from siltstone.plans.corpus import _split
from siltstone.plans.registry import query
from siltstone.plans.selection import FAMILIES, _ex, examples
from siltstone.runtime import table
from siltstone.sources import crawl, readers

_rows = "(select distinct doc_id, source_group_id, split, text, label, spans, domain, generator_family, generator_released from raw_examples where text is not null and split is not null)"
_number = lambda key, salt: f"(('0x' || substr(sha256({key} || '|{salt}'), 1, 8))::bigint / 4294967296.0::double)"


def _uniform(key, salt):
    return H.digest_number(key, salt, 8) / 4294967296.0


# ---- training rows ----
_ai_chars = "coalesce(list_sum(list_transform(list_filter(spans, lambda s: s.label <> 'human'), lambda s: s.end_char - s.start_char)), 0)"


@query(
    f"""select doc_id, split, case when spans is null then label when {_ai_chars} / greatest(length(text), 1)::double >= 0.5 then 1 else 0 end as label, case when spans is null then 1 else len(spans) end as n_spans,
case when spans is null and label = 1 then generator_family else 'unknown' end as family from {_rows} where split in ('train', 'val') and (spans is not null or label is not null)"""
)
def train_example_rows(spark, d):
    """Human, machine and mixed rows of two splits as one training set."""
    rows = table(spark, d, "raw_examples").where("text is not null").select("doc_id", "source_group_id", "split", "text", "label", "spans", "domain", "generator_family", "generator_released").distinct()
    whole = rows.where("spans is null")
    out = readers.training_rows(whole.where("label = 0"), whole.where("label = 1"), rows.where("spans is not null"), ["train", "val"])
    return out.select("doc_id", "split", "label", F.size("spans").alias("n_spans"), F.col("generator_family").alias("family"))


@query(f"select len(regexp_extract_all(text, '[^{T.SPACE}]+')) as token_count, count(*) as n from (select distinct doc_id, text from raw_examples where label = 0 and text is not null) group by all")
def train_length_pool(spark, d):
    humans = table(spark, d, "raw_examples").where("label = 0 and text is not null").select("doc_id", "text").distinct()
    return readers.length_pool(humans.select(T.token_count(F.col("text")).alias("token_count")))


@query(
    """with r as (select source_id, text, row_number() over (partition by source_id order by acquired_at, source_record_id) as k from (select distinct source_id, source_record_id, text, acquired_at from raw_records where source_id is not null)),
t as (select source_id, k, length(text) >= 400 as ok from r where k <= 60), g as (select source_id, ok, k, sum(ok::int) over (partition by source_id order by k) as got from t)
select source_id, count(*) as seen, count(*) filter (ok) as kept, 20 as wanted, least(count(*) filter (ok), 20) as taken, round(count(*) filter (ok) / count(*)::double, 4) as keep_rate, count(*) filter (ok) < 20 as short from g group by source_id"""
)
def read_quota_report(spark, d):
    """At most three times a source's quota is read, in order of arrival; what passes fills the quota."""
    rows = table(spark, d, "raw_records").where("source_id is not null").select("source_id", "source_record_id", "text", "acquired_at").distinct()
    return readers.quota_report(rows, "source_id", F.length("text") >= 400, 20, 3, F.col("acquired_at"), F.col("source_record_id"))


@query("select domain, count(*) as n from (select * from (select * from benchmark_docs order by doc_id limit 300) where domain <> 'news' and coalesce(attack, 'none') = 'none') group by domain")
def read_capped_benchmark(spark, d):
    """A cap on the rows read, before the filter: it bounds work and doesn't choose rows."""
    rows = readers.capped(table(spark, d, "benchmark_docs"), 300, F.col("doc_id"))
    return rows.where((F.col("domain") != "news") & (F.coalesce("attack", F.lit("none")) == "none")).groupBy("domain").agg(F.count("*").alias("n"))


# ---- scoring ----
_tokens = f"regexp_extract_all(text, '[{T.WORD_CHAR}]+')"
_win = f"""(with t as (select doc_id::varchar as doc_id, {_tokens} as w from documents where text is not null), n as (select doc_id, w, unnest(range(0, case when len(w) <= 0 then 0 when len(w) <= 120 then 1 else ceil((len(w) - 120) / 90.0)::int + 1 end)) as i from t)
select doc_id, list_slice(w, i * 90 + 1, i * 90 + 120) as w from n)"""
_scores = f"(select doc_id, round(avg(s), 8) as score_mean, round(max(s), 8) as score_max, count(*)::int as n_windows, bool_or(bad) as bad from (select doc_id, len(list_filter(w, lambda x: length(x) >= 7)) / len(w)::double as s, list_contains(w, '1905') as bad from {_win}) group by doc_id)"


def _long_words():
    """A stand-in for a model: the share of long words; it can't score windows with a certain year."""

    def score(windows):
        words = [WORD_RUN.findall(w) for w in windows]
        if any("1905" in w for w in words):
            raise ValueError("not scored")
        return [sum(len(x) >= 7 for x in w) / len(w) for w in words]

    return score


def _scored(spark, d):
    s = scoring.scored_documents(table(spark, d, "documents").select("doc_id", "text"), "long words", _long_words, 120, 90)
    return s.withColumn("score_mean", F.round("score_mean", 8)).withColumn("score_max", F.round("score_max", 8))


@query(f"select doc_id, case when bad then null else score_mean end as score_mean, case when bad then null else score_max end as score_max, n_windows, bad as failed from {_scores}")
def score_documents(spark, d):
    return _scored(spark, d)


@query(f"select doc_id, score_mean, score_max, n_windows from {_scores} where not bad and score_mean >= 0.4")
def score_scan_hits(spark, d):
    return scoring.scan_hits(_scored(spark, d), 0.4)


@query(f"select count(*) as scanned, count(*) filter (bad) as errors, count(*) filter (not bad and score_mean >= 0.4) as above_threshold from {_scores}")
def score_scan_totals(spark, d):
    return scoring.scan_totals(_scored(spark, d), 0.4)


@query(f"select s.doc_id, score_mean, sha2 from {_scores} s join (select doc_id::varchar as doc_id, sha256(text) as sha2 from documents) t using (doc_id) where not bad and score_mean >= 0.4")
def mine_failure_texts(spark, d):
    """The texts of confident errors, looked up in the pool they were found in."""
    pool = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return mining.with_texts(scoring.scan_hits(_scored(spark, d), 0.4).select("doc_id", "score_mean"), pool, "doc_id").select("doc_id", "score_mean", F.sha2("text", 256).alias("sha2"))


@query("select user_id, sum(value) as total, max((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) // 1000) as oldest_ms, sum(value) >= 2000 or max((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) // 1000) >= 2600000000 as flush from (select user_id, ts, floor(value)::bigint as value from events where event_type = 'click') group by user_id")
def batch_flush(spark, d):
    events = table(spark, d, "events").where("event_type = 'click'")
    age = F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return scoring.should_flush(events, "user_id", F.floor("value"), F.floor(age / 1000), 2000, 2_600_000_000)


# ---- crawl ----
_names = "(select case when starts_with(url, '/') then list_extract(string_split(url, '/'), -1) else url end as x from documents where url is not null)"


@query(f"select substr(sha256(string_agg(x || chr(10), '' order by x)), 1, 16) as fingerprint, count(*) as n from {_names}")
def crawl_fingerprint(spark, d):
    return crawl.segment_fingerprint(table(spark, d, "documents").select("url"), "url")


@query(
    f"""select source_config, count(*) as n_docs, sha256(string_agg(source_record_id, chr(10) order by source_record_id)) as ids_sha256, count(*) filter (s = 'train') as train, count(*) filter (s = 'val') as val, count(*) filter (s = 'test') as test
from (select source_config, source_record_id, {_split("('grp_' || source_record_id)")} as s from (select distinct source_config, source_record_id from raw_records where source_config is not null and source_record_id is not null)) group by source_config"""
)
def crawl_manifest(spark, d):
    docs = table(spark, d, "raw_records").where("source_config is not null and source_record_id is not null").select("source_config", "source_record_id").distinct()
    return crawl.crawl_manifest(docs, "source_config", "source_record_id")


# ---- reports ----
_regimes = f"""(with s as (select doc_id, label as y, {_number('doc_id', 'score')} * 0.7 + label * 0.3 as score, split, generator_family, domain from {_ex} where label is not null),
g as (select 'R1_iid' as name, y, score from s where split = 'val' union all select 'R3_unseen_generator', y, score from s where coalesce(generator_family, '') in ('human', 'tidewrack') union all select 'R5_adversarial', y, score from s where domain = 'reviews'),
k as (select *, rank() over (partition by name order by score) + (count(*) over (partition by name, score) - 1) / 2.0 as r, count(*) filter (y = 1) over (partition by name) as p, count(*) filter (y = 0) over (partition by name) as n from g)
select name, count(*) filter (score >= 0.5 and y = 0) / nullif(count(*) filter (y = 0), 0)::double as fpr, count(*) filter (score < 0.5 and y = 1) / nullif(count(*) filter (y = 1), 0)::double as fnr, (sum(case when y = 1 then r end) - max(p) * (max(p) + 1) / 2.0) / nullif(max(p) * max(n), 0) as auroc from k group by name)"""
_pick = lambda name, c: f"round(max({c}) filter (name = '{name}'), 8)"


@query(f"select {_pick('R1_iid', 'fpr')} as human_fpr, {_pick('R1_iid', 'fnr')} as ai_fnr, {_pick('R3_unseen_generator', 'auroc')} as ood_auroc, {_pick('R5_adversarial', 'fnr')} as adversarial_fnr from {_regimes}")
def report_headline(spark, d):
    """Figures of three regimes, each taken from the regime it is defined on."""
    from siltstone.operators import metrics

    rows = examples(spark, d).where("label is not null").select("split", "generator_family", "domain", F.col("label").alias("y_true"), (_uniform(F.col("doc_id"), "score") * 0.7 + F.col("label") * 0.3).alias("score"))
    named = [("R1_iid", rows.where("split = 'val'")), ("R3_unseen_generator", rows.where("coalesce(generator_family, '') in ('human', 'tidewrack')")), ("R5_adversarial", rows.where("domain = 'reviews'"))]
    each = [part.select(F.lit(name).alias("name"), "y_true", "score") for name, part in named]
    every = each[0].unionByName(each[1]).unionByName(each[2])
    figures = metrics.rates(every, 0.5, ["name"]).join(metrics.auroc(every, ["name"]), "name").join(metrics.calibration_error(every, ["name"]), "name")
    return reports.headline(figures).drop("ece").select(*(F.round(c, 8).alias(c) for c in ("human_fpr", "ai_fnr", "ood_auroc", "adversarial_fnr")))


@query(
    f"""select run, step, fpr, fnr, fpr <= 0.01 as in_budget from (select *, row_number() over (partition by run order by fpr > 0.01, case when fpr <= 0.01 then fnr else fpr end, step) as r from
(select o_orderpriority as run, o_orderkey as step, round({_number('o_orderkey::varchar', 'fpr')} * 0.2, 4) as fpr, round({_number('o_orderkey::varchar', 'fnr')}, 3) as fnr from orders)) where r = 1"""
)
def report_best_checkpoint(spark, d):
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("step"), F.round(_uniform(key, "fpr") * 0.2, 4).alias("fpr"), F.round(_uniform(key, "fnr"), 3).alias("fnr"))
    return reports.best_checkpoint(rows, "run", 0.01)


_low = "regexp_replace(lower(coalesce(model, '')), '[^a-z0-9]+', ' ', 'g')"
_has = lambda markers: " or ".join(f"contains({_low}, '{m}')" for m in markers)
_cross = f"(select label, count(*) filter (e = 'human') as human, count(*) filter (e = 'generator') as generator, count(*) filter (e = 'none') as none from (select label, case when {_has(reports.HUMAN_MARKERS)} then 'human' when {_has(reports.GENERATOR_MARKERS)} then 'generator' else 'none' end as e from (select label, case model when 'basalt' then 'gpt-basalt' when 'ember' then 'ember/T5' else model end as model from benchmark_docs)) group by label)"


def _evidence(spark, d):
    named = F.when(F.col("model") == "basalt", "gpt-basalt").when(F.col("model") == "ember", "ember/T5").otherwise(F.col("model"))
    return reports.evidence_crosstab(table(spark, d, "benchmark_docs").select("label", named.alias("src")), "label", "src")


@query(f"select *, generator / greatest(1, generator + human)::double as generator_share from {_cross}")
def report_label_evidence(spark, d):
    return _evidence(spark, d)


@query(f"select label from (select label, generator / greatest(1, generator + human)::double as s, count(*) filter (generator / greatest(1, generator + human)::double > 0.9) over () as k from {_cross}) where s > 0.9 and k = 1")
def report_machine_label(spark, d):
    return reports.machine_label(_evidence(spark, d), "label")


@query(f"select generator_family, count(*) as n_rows from {_ex} where split = 'train' and generator_family in ('{FAMILIES[3]}', '{FAMILIES[4]}') group by generator_family")
def report_held_out_leaks(spark, d):
    roster = spark.createDataFrame([(f, "held_out" if i > 2 else "held_in") for i, f in enumerate(FAMILIES)], "family string, role string")
    return reports.held_out_leaks(examples(spark, d).where("split = 'train'"), "generator_family", roster)


@query(
    f"""with h as (select 'held' as side, doc_id as id, sha256(text) as h from {_ex} where split in ('val', 'test') and text is not null), t as (select min(doc_id) as train_id, sha256(text) as h from {_ex} where split = 'train' and text is not null group by 2)
select (select count(*) from t) as n_train, (select count(*) from h) as n_eval, count(*) as exact_overlap, count(*) = 0 as clean from h join t using (h)"""
)
def contamination_report(spark, d):
    """Held-out rows whose whole text stands in train."""
    rows = examples(spark, d).where("text is not null").select("split", F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    return evaluation.contamination_report(rows.where("split in ('val', 'test')"), rows.where("split = 'train'"), "hash")


# ---- image records, by their metadata ----
def _images(spark, d):
    raw = table(spark, d, "raw_records").where("source_record_id is not null")
    return raw.select(F.col("source_record_id").alias("image_id"), "license", F.when(F.col("register").isNotNull(), H.split_of_group(F.col("source_record_id"))).alias("split"), F.col("text").alias("note"))


_images_sql = f"(select source_record_id as image_id, license, case when register is not null then {_split('source_record_id')} end as split, text as note from raw_records where source_record_id is not null)"


@query(f"select image_id, case when bool_or(coalesce(length(note) > 4096, false) or coalesce(length(license) > 4096, false)) then 'oversized_field' when count(*) > 1 then 'repeated' else 'no_split' end as fault from {_images_sql} group by image_id having bool_or(coalesce(length(note) > 4096, false) or coalesce(length(license) > 4096, false)) or count(*) > 1 or bool_or(split is null)")
def image_manifest_faults(spark, d):
    return reports.manifest_faults(_images(spark, d), "image_id")


@query(f"select case grouping(split, license) when 3 then 'images' when 1 then 'split' else 'license' end as kind, coalesce(split, license) as value, count(*) as n from {_images_sql} group by grouping sets ((), (split), (license))")
def image_manifest_summary(spark, d):
    return reports.manifest_summary(_images(spark, d))


@query("select lower(trim(split)) as split, label, count(*) as samples, count(distinct source) as kinds, count(distinct source_group_id) as groups, count(source_human_id) as with_mask from (select distinct doc_id, split, label, source, source_group_id, source_human_id from raw_examples) group by all")
def image_index_summary(spark, d):
    rows = table(spark, d, "raw_examples").select("doc_id", F.lower(F.trim("split")).alias("split"), "label", F.col("source").alias("kind"), F.col("source_group_id").alias("group_id"), F.col("source_human_id").alias("mask_ref"), F.col("split").alias("as_spelled")).distinct()
    return reports.index_summary(rows)


#: Inventories of the unmatched captions (fixed values).
PALETTES = ["muted neutrals", "cool greys and blues", "warm browns and creams", "soft greens"]
TIMES = ["morning", "midday", "late afternoon", "evening"]
_byte = lambda prefix, key, n: f"(('0x' || substr(sha256('{prefix}:' || {key}), 1, 8))::bigint % {n} + 1)"


@query(f"select p_partkey, {PALETTES}[{_byte('unmatched-v1:palette', 'p_partkey::varchar', 4)}] as palette, {TIMES}[{_byte('unmatched-v1:time', 'p_partkey::varchar', 4)}] as time from part")
def image_unmatched_picks(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", reports.unmatched_pick(PALETTES, key, "palette").alias("palette"), reports.unmatched_pick(TIMES, key, "time").alias("time"))


_area = f"{reports.AREA_FRACTIONS}[{_byte('composite-v1:area', 'p_partkey::varchar', 4)}]::double"
_pos = "sha256('composite-v1:pos:' || p_partkey::varchar)"


@query(
    f"""select p_partkey, {reports.SHAPES}[{_byte('composite-v1:shape', 'p_partkey::varchar', 2)}] as shape, {reports.FEATHERS}[{_byte('composite-v1:feather', 'p_partkey::varchar', 4)}] as feather, area, side, ('0x' || substr({_pos}, 1, 4))::bigint % greatest(w - side, 1) as "left", ('0x' || substr({_pos}, 5, 4))::bigint % greatest(h - side, 1) as top
from (select *, least(greatest(floor(sqrt(w * h * area))::bigint, 16), w - 2, h - 2) as side from (select p_partkey, 100 + p_size * 8 as w, 120 + p_size * 5 as h, {_area} as area from part))"""
)
def image_composite_geometry(spark, d):
    geometry = reports.composite_geometry(F.col("p_partkey"), F.lit(100) + F.col("p_size") * 8, F.lit(120) + F.col("p_size") * 5)
    return table(spark, d, "part").select("p_partkey", *(c.alias(name) for name, c in geometry.items()))


@query(
    """select doc_id, case when length(url) > 400 then 'too_long:scene' when regexp_matches(url, '(?i)\\b(?:https?://|www\\.)\\S+') then 'identifying:scene' when coalesce(trim(register), '') = '' then 'empty:objects' when coalesce(trim(lang), '') = '' then 'empty:lighting' end as fault
from (select doc_id, register, lang, regexp_replace(coalesce(url, 'a plain view'), '^https?://[a-m]', 'a view of ') as url from documents) where coalesce(trim(url), '') <> ''"""
)
def image_caption_faults(spark, d):
    """Faults of captions made of the documents' metadata."""
    url = F.regexp_replace(F.coalesce("url", F.lit("a plain view")), "^https?://[a-m]", "a view of ")
    fields = dict.fromkeys(reports.CAPTION_FIELDS, F.lit("plain")) | {"scene": url, "objects": F.col("register"), "lighting": F.col("lang")}
    order = table(spark, d, "documents").where(F.trim(url) != "")
    return order.select("doc_id", reports.caption_fault(fields).alias("fault"))


# ---- rest of the reports ----
@query(
    """with s as (select source_config as segment, count(*) as seen, count(*) filter (length(text) >= 400) as kept, min(source_id) as worker, count(*) / 7.0::double as seconds, case when count(*) < 6 then 'cut off' end as error from raw_records where source_config is not null group by source_config)
select count(*) filter (error is null) as segments_read, array_to_string(list_sort(list(segment) filter (error is not null)), ',') as failed, sum(seen)::bigint as seen, sum(kept)::bigint as kept, round_even(sum(kept) / sum(seen)::double, 4) as keep_rate, count(distinct worker) as workers, round(max(seconds), 3) as seconds_max, round(sum(seconds), 3) as seconds_sum from s"""
)
def gates_merged_segments(spark, d):
    from siltstone.operators import gates

    raw = table(spark, d, "raw_records").where("source_config is not null")
    per = raw.groupBy(F.col("source_config").alias("segment")).agg(F.count("*").alias("seen"), F.count_if(F.length("text") >= 400).alias("kept"), F.min("source_id").alias("worker"))
    per = per.withColumn("seconds", F.col("seen") / 7.0).withColumn("error", F.when(F.col("seen") < 6, "cut off"))
    return gates.merge_segments(per).withColumn("failed", F.array_join("failed", ","))


@query("with h as (select domain as cell, count(*) as m from benchmark_docs where label = 0 group by domain), a as (select domain as cell, count(*) as n from benchmark_docs where label = 1 group by domain) select cell, round(share, 8) as share, available, floor(available / share)::bigint as cap from (select cell, m / (sum(m) over ())::double as share, coalesce(n, 0) as available from h left join a using (cell)) order by cap, cell limit 5")
def sample_binding_cells(spark, d):
    from siltstone.operators import sampling

    rows = table(spark, d, "benchmark_docs")
    ai, human = (rows.where(F.col("label") == x).groupBy(F.col("domain").alias("cell")).agg(F.count("*").alias("n")) for x in (1, 0))
    return sampling.binding_cells(ai, human, "cell").withColumn("share", F.round("share", 8))


_clustered = "(select vec_id, vec_id % 6 as cluster, (vec_id * 7 // 5 % 3)::varchar as domain, (vec_id % 2)::varchar as source, case when vec_id % 5 = 0 then 'ai_false_negative' else 'human_false_positive' end as failure_type from embeddings)"


def _clusters(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(v.alias("pos"), (v % 6).alias("cluster"), (F.floor(v * 7 / 5) % 3).cast("string").alias("domain"), (v % 2).cast("string").alias("source"), F.when(v % 5 == 0, "ai_false_negative").otherwise("human_false_positive").alias("failure_type"))


@query(f"select cluster, failure_type, count(*) as n from {_clustered} group by all")
def mine_failure_types(spark, d):
    return mining.failure_types(_clusters(spark, d))


@query(
    f"""with t as (select cluster, domain, row_number() over (partition by cluster order by count(*) desc, min(vec_id)) as r from {_clustered} group by cluster, domain), u as (select cluster, source, row_number() over (partition by cluster order by count(*) desc, min(vec_id)) as r from {_clustered} group by cluster, source),
l as (select domain || ' / ' || source as label from t join u using (cluster) where t.r = 1 and u.r = 1) select 'split_mode' as warning, label as detail from l group by label having count(*) > 1
union all select 'surface_embedder', 'hashing_v1' union all select 'poorly_separated', '0.310' union all (select 'merged_modes', cluster::varchar from (select cluster, count(*) as n, count(*) / (sum(count(*)) over ())::double as s from {_clustered} group by cluster order by n desc, cluster limit 1) where s > 0.1)"""
)
def mine_atlas_warnings(spark, d):
    rows = _clusters(spark, d)
    summary = mining.cluster_summary(rows.select(F.col("pos").alias("doc_id"), "cluster", F.lit(0.5).alias("confidence")))
    return mining.atlas_warnings(summary, mining.cluster_labels(rows, ["domain", "source"]), 0.31, "hashing_v1", 0.4, 0.1)


@query(
    f"""with s as (select ('0x' || substr(sha256('negative-control:' || doc_id), 1, 8))::bigint % 2 as y, {_number('doc_id::varchar', 'score')} as score from documents), k as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from s),
a as (select (sum(case when y = 1 then r end) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auroc, count(*) as n from k)
select round(auroc, 8) as auroc, n, round(4 / (2 * sqrt(n)), 8) as margin, abs(auroc - 0.5) <= 4 / (2 * sqrt(n)) as passed from a"""
)
def control_auroc(spark, d):
    from siltstone.operators import metrics
    from siltstone.plans.selection import control_arbitrary_labels

    rows = control_arbitrary_labels(spark, d).select(F.col("label").alias("y_true"), _uniform(F.col("doc_id").cast("string"), "score").alias("score"))
    return metrics.negative_control(rows).withColumn("auroc", F.round("auroc", 8)).withColumn("margin", F.round("margin", 8))


@query()
def metric_mcnemar_values(spark, d):
    from siltstone.operators import metrics

    rows = examples(spark, d).where("label is not null").select(F.col("label").alias("y_true"), (_uniform(F.col("doc_id"), "score") * 0.7 + F.col("label") * 0.3).alias("a"), (_uniform(F.col("doc_id"), "other") * 0.6 + F.col("label") * 0.4).alias("b"))
    return metrics.mcnemar_values(rows, 0.5, 0.5)
