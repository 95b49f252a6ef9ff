"""Sampling, caps, quotas, assignment and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.operators import evaluation, sampling
from siltstone.plans.corpus import _split, _tokens
from siltstone.plans.registry import query
from siltstone.runtime import table
from siltstone.sources import readers

FAMILIES = ["basalt", "ember", "larkspur", "quillon", "tidewrack"]
TEMPERATURES, TOP_PS, GRID_MAX = [0.3, 0.7, 1.0], [0.9, 0.95], 640
_num = lambda key, salt, n=12: f"('0x' || substr(sha256({key} || '|{salt}'), 1, {n}))::bigint"
#: raw_examples with their repeated rows once.
_ex = "(select distinct doc_id, source_group_id, split, text, label, domain, generator_family, generator_released, source_human_id, source from raw_examples)"


def examples(spark, d):
    return table(spark, d, "raw_examples").select("doc_id", "source_group_id", "split", "text", "label", "domain", "generator_family", "generator_released", "source_human_id", "source").distinct()


@query("select doc_id from (select doc_id from documents order by sha256('subsample:' || doc_id), doc_id limit 200)")
def sample_subsample(spark, d):
    return sampling.subsample(table(spark, d, "documents").select("doc_id"), "doc_id", 200)


@query(f"select label, doc_id from (select label, doc_id, row_number() over (partition by label order by sha256('ood-sample' || doc_id), doc_id) as r from {_ex}) where r <= 50")
def sample_stratified(spark, d):
    return sampling.per_group(examples(spark, d).select("label", "doc_id"), ["label"], 50, sampling.hash_order(F.col("doc_id"), "ood-sample"), F.col("doc_id"))


_cap_sql = f"""with e as (select doc_id, lower(trim(split)) as split from {_ex}), s as (select split, count(*) as n from e where split is not null group by split), q as (select split, n, case when row_number() over (order by split desc) = 1 then null else round_even(300.0 * n / (sum(n) over ()), 0) end as share from s),
r as (select split, coalesce(share, 300 - (select sum(share) from q))::int as quota from q) select split, doc_id from (select e.split, e.doc_id, quota, row_number() over (partition by e.split order by sha256('cap:' || doc_id), doc_id) as k from e join r on e.split = r.split) where k <= quota"""


@query(_cap_sql)
def sample_cap_per_split(spark, d):
    return sampling.cap_per_group(examples(spark, d).where("split is not null").select(F.lower(F.trim("split")).alias("split"), "doc_id"), "split", "doc_id", 300)


_cell = f"split || '|' || (case when {_tokens} >= 1100 then 6 when {_tokens} >= 750 then 5 when {_tokens} >= 500 then 4 when {_tokens} >= 350 then 3 when {_tokens} >= 250 then 2 when {_tokens} >= 150 then 1 else 0 end)"


@query(
    f"""with c as (select doc_id, label, {_cell} as cell from {_ex} where text is not null and split is not null), h as (select cell, count(*) as m from c where label = 0 group by cell), a as (select cell, count(*) as n from c where label = 1 group by cell),
q as (select cell, coalesce(n, 0) as n, least(floor(150.0 * coalesce(m, 0) / (select sum(m) from h)), coalesce(n, 0)) as first from a full join h using (cell)),
u as (select cell, unnest(range(1, (n - first)::bigint + 1)) as round, n - first as spare from q), more as (select cell, count(*) as k from (select cell from u order by round, spare desc, cell limit (select greatest(150 - sum(first), 0)::bigint from q)) group by cell),
t as (select cell, case when sum(n) over () <= 150 then n else first + coalesce(k, 0) end as quota from q left join more using (cell))
select cell, doc_id from (select cell, doc_id, quota, row_number() over (partition by cell order by sha256('cap:' || doc_id), doc_id) as r from (select * from c where label = 1) join t using (cell)) where r <= quota"""
)
def sample_length_matched(spark, d):
    """Machine rows capped to 150 with the length shape of the human rows, per (split, length bin)."""
    rows = examples(spark, d).where("text is not null and split is not null").select("doc_id", "label", F.concat_ws("|", "split", T.length_bin(T.token_count(F.col("text"))).cast("string")).alias("cell"))
    ai, human = rows.where("label = 1"), rows.where("label = 0")
    quotas = sampling.matched_quotas(sampling.group_sizes(ai, "cell"), sampling.group_sizes(human, "cell"), "cell", 150)
    return sampling.by_quota(ai, "cell", quotas, sampling.hash_order(F.col("doc_id"), "cap:"), F.col("doc_id")).select("cell", "doc_id")


@query(f"with c as (select label, split || '|' || (case when {_tokens} >= 1100 then 6 when {_tokens} >= 750 then 5 when {_tokens} >= 500 then 4 when {_tokens} >= 350 then 3 when {_tokens} >= 250 then 2 when {_tokens} >= 150 then 1 else 0 end) as cell from {_ex} where text is not null and split is not null), h as (select cell, count(*) as n from c where label = 0 group by cell), a as (select cell, count(*) as n from c where label = 1 group by cell) select min(floor(coalesce(a.n, 0) * (select sum(n) from h) / h.n))::bigint as budget from h left join a using (cell)")
def sample_matched_budget(spark, d):
    rows = examples(spark, d).where("text is not null and split is not null").select("label", F.concat_ws("|", "split", T.length_bin(T.token_count(F.col("text"))).cast("string")).alias("cell"))
    return sampling.matched_budget(*(sampling.group_sizes(rows.where(F.col("label") == label), "cell") for label in (1, 0)), "cell")


@query(f"select source, split, doc_id from (select *, row_number() over (partition by source, split order by doc_id) as r from {_ex} where split is not null and source is not null) order by r, source, split limit 120")
def sample_interleave(spark, d):
    rows = examples(spark, d).where("split is not null and source is not null").select("source", "split", "doc_id")
    return sampling.interleave(rows, ["source", "split"], 120, F.col("doc_id"))


@query(f"with s as (select source, count(*) as n from {_ex} where source is not null group by source), e as (select source, n, 100.0 * n / sum(n) over () as x from s), q as (select source, case when sum(n) over () <= 100 then n else floor(x) end + case when sum(n) over () > 100 and row_number() over (order by x - floor(x) desc, source) <= 100 - sum(floor(x)) over () then 1 else 0 end as quota from e) select source, quota::int as quota from q")
def sample_largest_remainder(spark, d):
    return sampling.largest_remainder(sampling.group_sizes(examples(spark, d), "source"), "source", 100)


@query("select vec_id, label, confidence from (select vec_id, label, confidence, row_number() over (partition by label order by confidence desc, vec_id) as r from (select vec_id, label, ('0x' || substr(sha256(vec_id::varchar), 1, 8))::bigint / 4294967296.0 as confidence from embeddings)) where r <= 7")
def select_top_per_cluster(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", (H.hex_number(F.sha2(F.col("vec_id").cast("string"), 256), 8) / 4294967296.0).alias("confidence"))
    return sampling.per_group(rows, ["label"], 7, F.desc("confidence"), F.col("vec_id"))


def _failures(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), (H.hex_number(F.sha2(F.col("vec_id").cast("string"), 256), 8) / 4294967296.0).alias("confidence"))


def _cluster_parts(sizes):
    return sampling.cluster_holdout([r["cluster"] for r in sizes.orderBy(F.desc("n"), "cluster").collect()])  # clusters are few


_place = f"('0x' || substr(sha256('cluster_' || cluster || '|{H.SALT}'), 1, 8))::bigint / 4294967295.0"


@query(f"select cluster, ('0x' || substr(sha256('cluster_' || cluster || '|{H.SALT}'), 1, 8))::bigint / 4294967295.0 < 0.25 as held_out from (select distinct label as cluster from embeddings)")
def select_cluster_holdout(spark, d):
    train, held = _cluster_parts(sampling.group_sizes(_failures(spark, d), "cluster"))
    return spark.createDataFrame([(c, c in held) for c in sorted(train + held)], "cluster long, held_out boolean")


@query(
    f"""with f as (select vec_id, label as cluster, ('0x' || substr(sha256(vec_id::varchar), 1, 8))::bigint as confidence from embeddings), z as (select cluster, count(*) as n, {_place} < 0.25 as held from f group by cluster),
q as (select cluster, n, least(n, 10) as low, (150 - sum(least(n, 10)) over ()) * n / (sum(n) over ())::double as x from z where not held), w as (select *, least(n, low + floor(x)) as part, x - floor(x) as frac from q), o as (select *, row_number() over (order by part >= n, frac desc, cluster) as k, 150 - sum(part) over () as spare from w),
t as (select cluster, part + case when part < n and k <= spare then 1 else 0 end as quota from o)
select vec_id, cluster, 'train' as part from (select vec_id, cluster, quota, row_number() over (partition by cluster order by confidence desc, vec_id) as r from f join t using (cluster)) where r <= quota union all select vec_id, cluster, 'holdout' from f join z using (cluster) where held"""
)
def select_proportional(spark, d):
    """Most confident errors per training cluster by floor and largest remainder, and all of the held-out clusters."""
    rows = _failures(spark, d)
    sizes = sampling.group_sizes(rows, "cluster")
    train, held = _cluster_parts(sizes)
    quotas = sampling.proportional_quotas(sizes.where(F.col("cluster").isin(train)), "cluster", 150)
    picked = sampling.by_quota(rows, "cluster", quotas, F.desc("confidence"), F.col("vec_id")).withColumn("part", F.lit("train"))
    return picked.unionByName(rows.where(F.col("cluster").isin(held)).withColumn("part", F.lit("holdout"))).select("vec_id", "cluster", "part")


@query("select vec_id from (select vec_id, ('0x' || substr(sha256(vec_id::varchar), 1, 8))::bigint as c from embeddings) order by c desc, vec_id limit 100")
def select_global_top(spark, d):
    return _failures(spark, d).orderBy(F.desc("confidence"), "vec_id").limit(100).select("vec_id")


@query(f"with q as (select source_id, round_even(0.8 * count(*), 0)::int as quota from (select distinct source_id, source_record_id from raw_records) where source_id is not null group by source_id) select source_id, count(*) as n, sum(case when r <= quota then 1 else 0 end)::bigint as n_train from (select s.source_id, quota, row_number() over (partition by s.source_id order by source_record_id) as r from (select distinct source_id, source_record_id from raw_records) s join q on s.source_id = q.source_id) group by source_id")
def select_train_quota(spark, d):
    rows = table(spark, d, "raw_records").where("source_id is not null").select("source_id", "source_record_id").distinct()
    quotas = sampling.group_sizes(rows, "source_id").select("source_id", F.bround(0.8 * F.col("n"), 0).cast("int").alias("quota"))
    train = sampling.by_quota(rows, "source_id", quotas, F.col("source_record_id")).groupBy("source_id").agg(F.count("*").alias("n_train"))
    return rows.groupBy("source_id").agg(F.count("*").alias("n")).join(train, "source_id")


@query(
    f"select doc_id, [{', '.join(repr(x) for x in FAMILIES)}][{_num('doc_id', 'family')} % 5 + 1] as family, [0.3, 0.3, 0.7, 0.7, 1.0, 1.0, 0.0][{_num('doc_id', 'decoding')} % 7 + 1]::double as temperature, [0.9, 0.95, 0.9, 0.95, 0.9, 0.95, 1.0][{_num('doc_id', 'decoding')} % 7 + 1]::double as top_p, {_num('doc_id', 'seed')} % 2147483648 as seed, greatest(96, least(floor({_tokens} * 1.35::double * 1.3::double)::int, 640)) as max_new_tokens from {_ex} where text is not null and label = 0"
)
def assign_generation(spark, d):
    """Family, decoding setting, seed and token budget of each human row's counterpart."""
    options = [(t, p) for t in TEMPERATURES for p in TOP_PS] + [(0.0, 1.0)]
    key = F.col("doc_id")
    rows = examples(spark, d).where("text is not null and label = 0")
    number = H.digest_number(key, "decoding")
    return rows.select("doc_id", H.pick(FAMILIES, H.digest_number(key, "family")).alias("family"), H.pick([t for t, _ in options], number).alias("temperature"), H.pick([p for _, p in options], number).alias("top_p"), F.pmod(H.digest_number(key, "seed"), F.lit(2**31)).alias("seed"), H.token_budget(T.token_count(F.col("text")), GRID_MAX).alias("max_new_tokens"))


@query(f"select id::varchar as id, {_num('id::varchar', 'topic')} % 46 as topic, {_num('id::varchar', 'genre')} % 8 as genre, {_num('id::varchar', 'register')} % 3 as register from range(500) t(id)")
def assign_unmatched(spark, d):
    i = F.col("id").cast("string")
    return spark.range(500).select(i.alias("id"), *(F.pmod(H.digest_number(i, salt), F.lit(n)).alias(salt) for salt, n in (("topic", 46), ("genre", 8), ("register", 3))))


@query(f"select e.doc_id, h.doc_id as human, coalesce(e.source_group_id = h.source_group_id, false) as same_group from {_ex} e join {_ex} h on e.source_human_id = h.doc_id")
def join_mirror_inheritance(spark, d):
    e = examples(spark, d)
    h = e.select(F.col("doc_id").alias("human"), F.col("source_group_id").alias("hg"))
    return e.join(h, e.source_human_id == h.human).select("doc_id", "human", F.coalesce(F.col("source_group_id") == F.col("hg"), F.lit(False)).alias("same_group"))


@query(f"select source_group_id, count(distinct split) as n_splits from {_ex} where source_group_id is not null group by source_group_id having count(distinct split) > 1")
def split_group_leaks(spark, d):
    return evaluation.group_leaks(examples(spark, d), "source_group_id", "split")


@query(f"select arm, split, count(*) as n from (select 'examples' as arm, coalesce(split, 'none') as split from {_ex} union all select 'benchmark', 'none' from benchmark_docs) group by all")
def set_union_arms(spark, d):
    a = examples(spark, d).select(F.lit("examples").alias("arm"), F.coalesce("split", F.lit("none")).alias("split"))
    b = table(spark, d, "benchmark_docs").select(F.lit("benchmark").alias("arm"), F.lit("none").alias("split"))
    return a.unionByName(b).groupBy("arm", "split").agg(F.count("*").alias("n"))


@query("select count(*) as n from (select sha256(text) as h from raw_records where text is not null intersect select sha256(text) from raw_examples where text is not null)")
def set_hash_intersection(spark, d):
    sha = lambda t: table(spark, d, t).where("text is not null").select(F.sha2("text", 256).alias("h"))
    return sha("raw_records").intersect(sha("raw_examples")).agg(F.count("*").alias("n"))


@query("select domain from (select domain from raw_examples where domain is not null except select domain from raw_examples where domain in ('web', 'news'))")
def set_train_keys(spark, d):
    keys = table(spark, d, "raw_examples").where("domain is not null").select("domain")
    return keys.subtract(keys.where(F.col("domain").isin("web", "news")))


@query("select 'only_left' as side, count(*) as n from (select distinct source from documents where doc_id % 2 = 0 and source is not null except select source from documents where doc_id % 2 = 1) union all select 'only_right', count(*) from (select distinct source from documents where doc_id % 2 = 1 and source is not null except select source from documents where doc_id % 2 = 0)")
def set_symmetric_difference(spark, d):
    """Shared-pool check: what either half lacks of the other, by one aggregation instead of two joins."""
    half = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.max((F.col("doc_id") % 2 == 0).cast("int")).alias("l"), F.max((F.col("doc_id") % 2 == 1).cast("int")).alias("r"))
    n = half.agg(F.count_if(F.expr("l = 1 and r = 0")).alias("a"), F.count_if(F.expr("l = 0 and r = 1")).alias("b"))
    return n.select(F.explode(F.array(F.struct(F.lit("only_left").alias("side"), F.col("a").alias("n")), F.struct(F.lit("only_right").alias("side"), F.col("b").alias("n")))).alias("x")).select("x.*")


@query(f"select split, bool_and(has0 and has1) as both_classes from (select split, count(*) filter (label = 0) > 0 as has0, count(*) filter (label = 1) > 0 as has1 from {_ex} where split is not null group by split) group by split")
def set_class_presence(spark, d):
    per = examples(spark, d).where("split is not null").groupBy("split").agg(F.collect_set("label").alias("labels"))
    return per.select("split", (F.array_contains("labels", 0) & F.array_contains("labels", 1)).alias("both_classes"))


@query(f"select generator_family, count(distinct generator_released) as n_releases, count(*) as n from {_ex} group by generator_family")
def set_arm_purity(spark, d):
    return examples(spark, d).groupBy("generator_family").agg(F.count_distinct("generator_released").alias("n_releases"), F.count("*").alias("n"))


@query(f"select {_split('coalesce(source_group_id, doc_id)')} as split, label, count(*) as n from {_ex} where doc_id is not null group by all")
def split_by_group(spark, d):
    rows = examples(spark, d).where("doc_id is not null")
    return rows.groupBy(H.split_of_group(F.coalesce("source_group_id", "doc_id")).alias("split"), "label").agg(F.count("*").alias("n"))


@query("select doc_id, ('0x' || substr(sha256('negative-control:' || doc_id), 1, 8))::bigint % 2 as label from documents")
def control_arbitrary_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", F.pmod(H.hex_number(F.sha2(F.concat(F.lit("negative-control:"), F.col("doc_id").cast("string")), 256), 8), F.lit(2)).alias("label"))


@query("select bucket, count(*) as n from (select (row_number() over (order by n_nationkey) - 1) % 4 as bucket from nation) group by bucket")
def plan_round_robin(spark, d):
    return sampling.round_robin_buckets(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 4).groupBy("bucket").agg(F.count("*").alias("n"))


@query("select doc_id from documents where text is not null and trim(text) <> '' order by doc_id limit 300")
def reserve_sorted_limit(spark, d):
    return readers.reserve_rows(table(spark, d, "documents").withColumn("source_group_id", F.col("source")), 300).select("doc_id")


@query("select r.r_name as region, count(*) as n_orders, round(sum(o.o_totalprice), 2) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name")
def relational_orders_by_region(spark, d):
    """Star join: the dimensions are small tables Catalyst broadcasts by their statistics."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
