"""Detector metrics, regimes, drift, decisions and feedback over deterministic scores.

Models are out of scope; the score of a row is a digest of its id, pulled towards its label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.operators import evaluation, metrics
from siltstone.plans.corpus import _tokens
from siltstone.plans.registry import query
from siltstone.plans.selection import _ex, examples
from siltstone.runtime import spread, table

R8 = lambda c: F.round(c, 8)
_u = lambda key, salt: f"(('0x' || substr(sha256({key} || '|{salt}'), 1, 8))::bigint / 4294967296.0::double)"
_sc = f"(select doc_id, label as y_true, ({_u('doc_id', 'score')} * 0.7 + label * 0.3) as score, coalesce(domain, 'unknown') as domain, source_group_id, text from {_ex} where label is not null)"


def uniform(key, salt):
    return H.digest_number(key, salt, 8) / 4294967296.0


def scored(spark, d):
    return examples(spark, d).where("label is not null").select("doc_id", F.col("label").alias("y_true"), (uniform(F.col("doc_id"), "score") * 0.7 + F.col("label") * 0.3).alias("score"), F.coalesce("domain", F.lit("unknown")).alias("domain"), "source_group_id", "text")


_rates = "round(count(*) filter (score >= 0.5 and y_true = 0) / nullif(count(*) filter (y_true = 0), 0)::double, 8) as fpr, round(count(*) filter (score < 0.5 and y_true = 1) / nullif(count(*) filter (y_true = 1), 0)::double, 8) as fnr, round(count(*) filter (score >= 0.5 and y_true = 1) / nullif(count(*) filter (score >= 0.5), 0)::double, 8) as precision"


def _rounded(df, *names):
    return df.select(*(R8(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


@query(f"select domain, {_rates} from {_sc} group by domain")
def metric_rates(spark, d):
    return _rounded(metrics.rates(scored(spark, d), 0.5, ["domain"]), "fpr", "fnr", "precision")


_auroc = "select {by} round((sum(case when y_true = 1 then r end) - p * (p + 1) / 2.0) / nullif(p * n, 0), 8) as auroc from (select {by} y_true, count(*) filter (y_true = 1) over ({part}) as p, count(*) filter (y_true = 0) over ({part}) as n, rank() over ({part} order by score) + (count(*) over ({tie}) - 1) / 2.0 as r from {src}) group by {by} p, n"


@query(_auroc.format(by="domain,", part="partition by domain", tie="partition by domain, score", src=_sc))
def metric_auroc_by_domain(spark, d):
    return _rounded(metrics.auroc(scored(spark, d), ["domain"]), "auroc")


@query(_auroc.format(by="", part="", tie="partition by score", src=f"(select label as y_true, {_tokens} as score from {_ex} where label is not null and text is not null)"))
def metric_length_gate(spark, d):
    """AUROC of the length alone, which should be near a half; with many ties."""
    rows = examples(spark, d).where("label is not null and text is not null").select(F.col("label").alias("y_true"), T.token_count(F.col("text")).alias("score"))
    return _rounded(metrics.auroc(rows), "auroc")


@query(f"select domain, round(sum(n * abs(acc - conf)) / sum(n), 8) as ece from (select domain, greatest(ceil(score * 15), 1) as bin, count(*) as n, avg(case when (score >= 0.5) = (y_true = 1) then 1.0 else 0.0 end) as acc, avg(greatest(score, 1 - score)) as conf from {_sc} group by domain, bin) group by domain")
def metric_calibration(spark, d):
    return _rounded(metrics.calibration_error(scored(spark, d), ["domain"]), "ece")


@query(f"with h as (select score, row_number() over (order by score) as r, count(*) over () as n from {_sc} where y_true = 0), t as (select score as thr from h where r = least(greatest(ceil(0.99 * n) - 1, 0), n - 1) + 1) select 0.01::double as budget, round(count(*) filter (score > thr and y_true = 0) / count(*) filter (y_true = 0)::double, 8) as fpr, round(count(*) filter (score <= thr and y_true = 1) / count(*) filter (y_true = 1)::double, 8) as fnr from {_sc}, t")
def metric_threshold_at_budget(spark, d):
    rows = scored(spark, d)
    return _rounded(metrics.rates(rows, metrics.threshold_at_fpr(rows, 0.01)), "fpr", "fnr").select(F.lit(0.01).alias("budget"), "fpr", "fnr")


@query(f"select domain, round(avg(case when score >= 0.6 then 1.0 else 0.0 end), 8) as fpr, count(*) as n_human, round(quantile_cont(score, 0.5), 8) as median, round(quantile_disc(score, 0.95), 8) as p95, round(quantile_disc(score, 0.99), 8) as p99, round(max(score), 8) as maximum from {_sc} where y_true = 0 group by domain")
def metric_condition_cost(spark, d):
    return _rounded(metrics.condition_cost(scored(spark, d), 0.6, ["domain"]), "fpr", "median", "p95", "p99", "maximum")


@query(f"select domain, count(*) filter (y_true = 0) as n_human, count(*) filter (y_true = 0) >= 50 as measurable from {_sc} group by domain")
def metric_measurable(spark, d):
    return metrics.measurable(scored(spark, d), 0.1, ["domain"])


@query(f"select source_group_id as \"group\", round(avg(score), 8) as score, max_by(y_true, doc_id) as y_true from {_sc} where source_group_id is not null group by source_group_id")
def metric_group_scores(spark, d):
    rows = scored(spark, d).where("source_group_id is not null").select(F.col("source_group_id").alias("group"), F.col("doc_id").alias("pos"), "y_true", "score")
    return _rounded(metrics.group_scores(rows), "score")


@query(f"select round(avg(score) filter (y_true = 1), 8) as mean_ai, round(avg(score) filter (y_true = 0), 8) as mean_human, avg(score) filter (y_true = 1) > avg(score) filter (y_true = 0) + 0.05 as holds from {_sc}")
def metric_polarity(spark, d):
    return _rounded(metrics.polarity(scored(spark, d)), "mean_ai", "mean_human")


@query(f"select b, c, round((abs(b - c) - 1) ** 2 / (b + c)::double, 6) as chi2 from (select count(*) filter (a <= 0.5 and e > 0.5) as b, count(*) filter (a > 0.5 and e <= 0.5) as c from (select label, {_u('doc_id', 'score')} * 0.7 + label * 0.3 as a, {_u('doc_id', 'other')} * 0.6 + label * 0.4 as e from {_ex} where label is not null) where label = 1)")
def metric_mcnemar(spark, d):
    rows = examples(spark, d).where("label is not null").select(F.col("label").alias("y_true"), (uniform(F.col("doc_id"), "score") * 0.7 + F.col("label") * 0.3).alias("a"), (uniform(F.col("doc_id"), "other") * 0.6 + F.col("label") * 0.4).alias("b"))
    return metrics.mcnemar_counts(rows, 0.5, 0.5).select("b", "c", F.round("chi2", 6).alias("chi2"))


@query()
def metric_paired_bootstrap(spark, d):
    """AUROC difference of two arms over resampled rows: Poisson weights per row and resample, all 10 000 resamples in one pass."""
    from siltstone.operators.resampling import paired_bootstrap

    rows = examples(spark, d).where("label is not null").select("doc_id", F.col("label").alias("y_true"), (uniform(F.col("doc_id"), "score") * 0.7 + F.col("label") * 0.3).alias("a"), (uniform(F.col("doc_id"), "other") * 0.6 + F.col("label") * 0.4).alias("b"))
    return paired_bootstrap(rows)


_tok = f"(select doc_id, pos, greatest(label, 0) as y_true, case when h % 5 = 0 then (label + 1) % 3 else label end as y_pred from (select doc_id, i as pos, (i / 7)::int % 3 as label, ('0x' || substr(sha256(doc_id || ':' || i), 1, 8))::bigint as h from (select doc_id, unnest(range(0, 40)) as i from {_ex})))"


def tokens(spark, d):
    base = examples(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("pos"))
    label = F.pmod(F.bround(F.col("pos") / 7).cast("int"), F.lit(3))
    h = H.hex_number(F.sha2(F.concat_ws(":", "doc_id", F.col("pos").cast("string")), 256), 8)
    return base.select("doc_id", "pos", label.alias("y_true"), F.when(h % 5 == 0, (label + 1) % 3).otherwise(label).alias("y_pred"))


@query(f"with t as (select doc_id, pos, y_true, y_pred from {_tok.replace('(i / 7)::int', 'round_even(i / 7.0, 0)::int')}) select cls, round(2.0 * tp / nullif(2 * tp + (np - tp) + (nt - tp), 0), 8) as f1, nt as support from (select cls, (select count(*) from t where y_true = cls) as nt, (select count(*) from t where y_pred = cls) as np, (select count(*) from t where y_true = cls and y_pred = cls) as tp from (select unnest([0, 1, 2]) as cls))")
def metric_token_f1(spark, d):
    return _rounded(metrics.token_f1(tokens(spark, d)), "f1")


@query()
def metric_segment_matches(spark, d):
    from siltstone.operators.spans import match_counts

    rows = tokens(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "y_true", "y_pred"))).alias("t"))
    return match_counts(rows.select("doc_id", F.transform("t", lambda x: x["y_true"]).alias("y_true"), F.transform("t", lambda x: x["y_pred"]).alias("y_pred")), "doc_id")


# ---- regimes ----
def _regime(name, key_sql, test, neutral):
    return f"with e as (select doc_id, source_group_id as g, coalesce({key_sql}, '{neutral}') as k from {_ex} where source_group_id is not null), s as (select g, arg_min(k, (k = '{neutral}')::int::varchar || doc_id) as k from e group by g) select e.doc_id, case when s.k in ({test}) then 'test' else 'train' end as side from e join s using (g)"


@query(_regime("domain", "domain", "'web', 'news'", ""))
def regime_unseen_domain(spark, d):
    rows = examples(spark, d).where("source_group_id is not null")
    return evaluation.held_out(rows, "source_group_id", F.col("domain"), "doc_id", ["web", "news"]).select("doc_id", "side")


@query(_regime("generator", "generator_family", "'ember', 'quillon'", "human"))
def regime_unseen_generator(spark, d):
    rows = examples(spark, d).where("source_group_id is not null")
    return evaluation.held_out(rows, "source_group_id", F.col("generator_family"), "doc_id", ["ember", "quillon"], "human").select("doc_id", "side")


@query(_regime("temporal", "case when coalesce(generator_released, '') = '' then 'none' when generator_released > '2024-01' then 'after' else 'before' end", "'after'", "none"))
def regime_temporal(spark, d):
    rows = examples(spark, d).where("source_group_id is not null")
    return evaluation.held_out(rows, "source_group_id", evaluation.release_key(F.col("generator_released"), "2024-01"), "doc_id", ["after"], "none").select("doc_id", "side")


@query(f"select coalesce(domain, 'unknown') as domain, coalesce(generator_family, 'unknown') as family, count(*) as n from {_ex} group by all")
def regime_inventory(spark, d):
    return examples(spark, d).groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("generator_family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"))


# ---- drift ----
_hist = lambda where: f"(select bin, n / sum(n) over ()::double as p from (select least(floor(value / 50.0)::int, 9) as bin, count(*) as n from events where value between 0 and 500 and {where} group by bin))"


@query(f"with b as (select unnest(range(10)) as bin), e as (select b.bin, greatest(coalesce(p, 0), 1e-6) as e from b left join {_hist('ts < timestamp ' + chr(39) + '2024-01-16' + chr(39))} h using (bin)), a as (select b.bin, greatest(coalesce(p, 0), 1e-6) as a from b left join {_hist('ts >= timestamp ' + chr(39) + '2024-01-16' + chr(39))} h using (bin)), s as (select sum((a - e) * ln(a / e)) as psi, sum(a * ln(a / e)) as kl from a join e using (bin)), n as (select count(value) filter (ts < timestamp '2024-01-16') as n_reference, count(value) filter (ts >= timestamp '2024-01-16') as n_current, avg(value) filter (ts < timestamp '2024-01-16') as rm, avg(value) filter (ts >= timestamp '2024-01-16') as cm from events) select round(psi, 8) as psi, round(kl, 8) as kl, round(rm, 6) as reference_mean, round(cm, 6) as current_mean, n_reference, n_current, case when least(n_reference, n_current) < 200 then 'unmeasurable' when psi >= 0.25 then 'significant' when psi >= 0.1 then 'minor' else 'stable' end as severity from s, n")
def drift_halves(spark, d):
    e = table(spark, d, "events").select("ts", "value")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    r = evaluation.drift_report(e.where(early), e.where(~early), "value", 10, 0.0, 500.0)
    return r.select(F.round("psi", 8).alias("psi"), F.round("kl", 8).alias("kl"), F.round("reference_mean", 6).alias("reference_mean"), F.round("current_mean", 6).alias("current_mean"), "n_reference", "n_current", "severity")


@query("select ts::date::varchar as day, least(floor(value / 50.0)::int, 9) as bin, count(*) as n from events where value between 0 and 500 group by all")
def drift_daily_histogram(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "value")
    return evaluation.histogram(e, "value", 10, 0.0, 500.0, ["day"])


# ---- decisions ----
@query(f"select doc_id, case when score >= 0.45 and score < 0.6 then 'uncertain' when score >= 0.5 then 'ai' else 'human' end as verdict, round(abs(score - 0.5) / 0.5, 8) as confidence from {_sc}")
def decision_three_way(spark, d):
    verdict, confidence = evaluation.decision(F.col("score"), 0.5, 0.45, 0.6)
    return scored(spark, d).select("doc_id", verdict.alias("verdict"), R8(confidence).alias("confidence"))


@query(f"select doc_id, round(1 / (1 + exp((1 - score - score) / 1.7)), 8) as p from {_sc}")
def decision_temperature(spark, d):
    return scored(spark, d).select("doc_id", R8(evaluation.softmax_ai(1 - F.col("score"), F.col("score"), 1.7)).alias("p"))


@query(f"with m as (select count(*) filter (score >= 0.5 and y_true = 0) / count(*) filter (y_true = 0)::double as fpr, count(*) filter (score < 0.5 and y_true = 1) / count(*) filter (y_true = 1)::double as fnr from {_sc}) select metric, round(value, 8) as value, lim::double as \"limit\", coalesce(value > lim, true) as failed from (select 'fpr' as metric, fpr as value, 0.01 as lim from m union all select 'fnr', fnr, 0.9 from m union all select 'ece', null, 0.05 from m)")
def decision_release_gate(spark, d):
    r = metrics.rates(scored(spark, d), 0.5)
    long = r.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("fpr", "fnr")))).alias("x")).select("x.*")
    gate = evaluation.release_gate(long, {"max_fpr": 0.01, "max_fnr": 0.9, "max_ece": 0.05})
    return _rounded(gate, "value")


# ---- feedback ----
_to = "case event_type when 'click' then 'under_review' when 'view' then 'verified' when 'purchase' then 'rejected' else 'unverifiable' end"


def feedback_events(spark, d):
    kind = F.col("event_type")
    to = F.when(kind == "click", "under_review").when(kind == "view", "verified").when(kind == "purchase", "rejected").otherwise("unverifiable")
    return table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("pos"), to.alias("to"), F.lit("r1").alias("verifier"), F.lit("human").alias("label"))


@query()
def feedback_fold(spark, d):
    """Final state of each item and how many of its events were illegal."""
    r = evaluation.transition_faults(feedback_events(spark, d))
    return r.select("item", F.col("r.state").alias("state"), F.size(F.filter("r.log", lambda x: x["fault"].isNotNull())).alias("n_illegal"))


@query("with f as (select user_id, event_id, " + _to + " as t from events), a as (select user_id, min(event_id) filter (t = 'under_review') as r, min(event_id) filter (t = 'unverifiable') as u from f group by user_id), s as (select a.user_id, case when r is null and u is null then 'submitted' when r is null or u < r then 'unverifiable' else coalesce((select arg_min(t, event_id) from f where f.user_id = a.user_id and f.event_id > a.r and f.t in ('verified', 'rejected', 'unverifiable')), 'under_review') end as state from a) select count(*) as total, count(*) filter (state in ('submitted', 'under_review')) as pending, count(*) filter (state in ('verified', 'rejected', 'unverifiable')) as reviewed, coalesce(round_even(count(*) filter (state = 'rejected') / nullif(count(*) filter (state in ('verified', 'rejected', 'unverifiable')), 0)::double, 4), 0.0) as rejection_rate from s")
def feedback_statistics(spark, d):
    r = evaluation.transition_faults(feedback_events(spark, d))
    return evaluation.feedback_stats(r.select("item", F.col("r.state").alias("state")))


# ---- contamination ----
@query("with e as (select doc_id as id, sha256(text) as h from benchmark_docs where text is not null), t as (select doc_id as id, sha256(text) as h from raw_examples where text is not null) select e.id as eval_id, min(t.id) as train_id from e join t using (h) group by e.id")
def contamination_exact(spark, d):
    e = table(spark, d, "benchmark_docs").where("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    t = table(spark, d, "raw_examples").where("text is not null").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    return evaluation.exact_contamination(e, t, "h")


@query()
def contamination_near(spark, d):
    """Benchmark texts whose estimated similarity to a training text is 0.5 or more (canonical texts, MinHash bands)."""
    from siltstone.functions.python_udfs import normalize
    from siltstone.operators import dedup

    e, t = (table(spark, d, name).where("text is not null").select(F.col("doc_id").alias("id"), normalize("text").alias("text")) for name in ("benchmark_docs", "raw_examples"))
    best = dedup.best_matches(dedup.signatures(e, "id", "text"), dedup.signatures(t, "id", "text"), 32, 4, 0.5)
    return best.select(F.col("id").alias("eval_id"), F.col("match").alias("train_id"), F.round("similarity", 6).alias("similarity"))


@query()
def contamination_near_splits(spark, d):
    """Held-out rows whose estimated similarity to a training row is 0.5 or more, with the most similar one."""
    from siltstone.functions.python_udfs import normalize
    from siltstone.operators import dedup

    rows = examples(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), "split", "text")
    e, t = (dedup.signatures(spread(rows.where(side).select("id", "text")).select("id", normalize("text").alias("text")), "id", "text") for side in ("split in ('val', 'test')", "split = 'train'"))
    best = dedup.best_matches(e, t, 32, 4, 0.5)
    return best.select(F.col("id").alias("eval_id"), F.col("match").alias("train_id"), F.round("similarity", 6).alias("similarity"))


@query(f"with s as (select score, y_true from {_sc}), h as (select score, row_number() over (order by score) as r, count(*) over () as n from s where y_true = 0), t as (select score as thr from h where r = least(greatest(ceil(0.95 * n) - 1, 0), n - 1) + 1), o as (select score, row_number() over (order by score) - 1 as r, count(*) over () as n from s), p as (select count(*) filter (score <= thr) as pos, greatest(floor(count(*) * 0.1 / 2), 1) as half, count(*) as n from s, t) select round((select min(score) from o where r = greatest(pos - half, 0)), 8) as low, round((select min(score) from o where r = least(pos + half, p.n - 1)), 8) as high from p")
def decision_abstention_band(spark, d):
    from siltstone.operators.calibration import abstention_band

    low, high = abstention_band(scored(spark, d).select("y_true", "score"), 0.05, 0.1)
    return spark.createDataFrame([(round(low, 8), round(high, 8))], "low double, high double")


@query()
def decision_fitted_temperature(spark, d):
    from siltstone.operators.calibration import fit_temperature

    logit = F.ln(F.col("score") / (1 - F.col("score")))
    rows = scored(spark, d).where("score > 0 and score < 1").select("y_true", F.lit(0.0).alias("human_logit"), (logit * 3).alias("ai_logit"))
    return spark.createDataFrame([fit_temperature(rows)], "temperature double, at_edge boolean")
