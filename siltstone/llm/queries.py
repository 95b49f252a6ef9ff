"""The pN_ queries and, where SQL can say it over whole tables, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import groupsplit, language, leaks, mixing, neardup, overlap, packing, quality, spam, splitting, tables, tokens
from siltstone.functions.text import SPACE, WORD_CHAR
from siltstone.runtime import cut, spread, table

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, d):
    return leaks.leaked_pairs(tables.records(spark, d), tables.held_out_items(spark, d)).select(F.col("record_id").alias("source_record_id"), F.col("item_id").alias("doc_id"))


@query
def p1_report(spark, d):
    return leaks.leak_report(tables.records(spark, d), tables.held_out_items(spark, d))


@query
def p1_clean(spark, d):
    raw = table(spark, d, "raw_records")
    pairs = leaks.leaked_pairs(tables.records(spark, d), tables.held_out_items(spark, d))
    return leaks.without_leaks(raw, pairs, "source_record_id").select("source_record_id", "source_id", "acquired_at")


@query
def p4_found(spark, d):
    members, pairs = neardup.near_duplicates(tables.records(spark, d), least=0.6, shingle=3)
    return neardup.as_record_pairs(members, pairs).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


@query
def p4_links(spark, d):
    return neardup.links_per_record(*neardup.near_duplicates(tables.records(spark, d))).withColumnRenamed("id", "source_record_id")


def _judged(spark, d):
    raw = table(spark, d, "raw_records").where(tables.has_text()).select(F.col("source_record_id").alias("id"), F.col("source_id").alias("source"), "text")
    return quality.scored(spread(raw), quality.common_map(table(spark, d, "common_words")), quality.policy_map(table(spark, d, "quality_policy")))


@query
def p5_found(spark, d):
    return _judged(spark, d).where("breaks and id is not null").select(F.col("id").alias("source_record_id")).distinct()


@query
def p5_statistics(spark, d):
    return _judged(spark, d).withColumnRenamed("id", "source_record_id").dropDuplicates(["source_record_id"])


def _labelled(spark, d, clean_only):
    raw = table(spark, d, "raw_records").where(tables.has_text() & F.col("source_record_id").isNotNull())
    raw = raw.select(F.col("source_record_id").alias("id"), F.col("source_id").alias("source"), "text", language.label_language(F.col("upstream_language.lang")).alias("label"))
    common = quality.common_map(table(spark, d, "common_words"))
    model = language.fit(raw, common)
    policy = (common, quality.policy_map(table(spark, d, "quality_policy"))) if clean_only else None
    return language.label_paragraphs(spread(raw), model, policy)


@query
def p6_found(spark, d):
    return language.mislabelled(_labelled(spark, d, True)).withColumnRenamed("id", "source_record_id")


@query
def p6_paragraphs(spark, d):
    return _labelled(spark, d, False).withColumnRenamed("id", "source_record_id").dropDuplicates(["source_record_id", "para_no"])


@query
def p6_records(spark, d):
    return language.record_languages(_labelled(spark, d, False)).withColumnRenamed("id", "source_record_id")


def _overlaps(spark, d, least, shingle):
    rows = tables.examples(spark, d).where(F.col("split").isNotNull() & tables.has_text())
    members, found = overlap.overlaps(spread(rows.select(F.col("doc_id").alias("id"), F.col("split").isin("val", "test").alias("held"), "text")), least, shingle)
    return rows, members, found


@query
def p2_found(spark, d):
    _, members, found = _overlaps(spark, d, 0.6, 3)
    return overlap.as_row_pairs(members, found).select(F.least("train_id", "held_id").alias("doc_id_a"), F.greatest("train_id", "held_id").alias("doc_id_b")).distinct()


@query
def p2_counts(spark, d):
    rows, members, found = _overlaps(spark, d, 0.6, 3)
    return overlap.overlap_counts(members, found, rows.select(F.col("doc_id").alias("id"), "split", "source"))


@query
def p2_coverage(spark, d):
    rows = tables.examples(spark, d).where(F.col("split").isNotNull() & tables.has_text())
    return overlap.record_coverage(spread(rows.select(F.col("doc_id").alias("id"), F.col("split").isin("val", "test").alias("held"), "text")), 3).withColumnRenamed("id", "doc_id")


def _related(spark, d):
    return tables.examples(spark, d).select(
        F.col("doc_id").alias("id"), F.nullif(F.lower(tables.stripped(F.col("source_group_id"))), F.lit("")).alias("group"), F.col("source_human_id").alias("parent"), "split"
    )


@query
def p7_found(spark, d):
    return groupsplit.tied_across_splits(_related(spark, d)).withColumnRenamed("id", "doc_id")


@query
def p7_splits(spark, d):
    return groupsplit.assign_splits(_related(spark, d)).withColumnRenamed("id", "doc_id")


@query
def p7_shares(spark, d):
    done = groupsplit.assign_splits(_related(spark, d))
    return done.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("root").alias("n_components"))


def _pages(spark, d):
    return spread(table(spark, d, "documents").where(tables.has_text()).select("doc_id", language.label_language(F.col("lang")).alias("lang"), "text"))


def _judged_pages(spark, d):
    return spam.judged_pages(_pages(spark, d), frozenset(quality.common_map(table(spark, d, "common_words"))))


@query
def p10_found(spark, d):
    return _judged_pages(spark, d).where("is_spam").select("doc_id")


@query
def p10_pages(spark, d):
    return _judged_pages(spark, d)


def _pieces(spark, d):
    rows = table(spark, d, "raw_examples").where(tables.has_text()).select("doc_id", "domain", "text", "spans")
    return splitting.pieces(spread(rows), table(spark, d, "piece_limits"))


@query
def p3_found(spark, d):
    return _pieces(spark, d).where("n_pieces > 1").select("doc_id").distinct()


@query
def p3_pieces(spark, d):
    return _pieces(spark, d)


def _packs(spark, d):
    return [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").orderBy("pack_id").collect()]


def _containers(spark, d):
    sizes = tokens.token_counts(spread(table(spark, d, "documents").select("doc_id", "source", "text")))
    return packing.containers(cut(sizes).select("doc_id", "n_tokens"), _packs(spark, d))


@query
def p8_containers(spark, d):
    return _containers(spark, d)


@query
def p8_fill(spark, d):
    return packing.fill_report(_containers(spark, d), _packs(spark, d))


def _mixed(spark, d, keep="size"):
    name = F.lower(tables.stripped(F.col("source")))
    sizes = tokens.token_counts(spread(table(spark, d, "documents").select("doc_id", name.alias("source"), "text")))
    return mixing.mixed(sizes, table(spark, d, "mix_targets").withColumn("source", name), keep)


@query
def p9_mix(spark, d):
    return _mixed(spark, d)[0]


@query
def p9_mix_shares(spark, d):
    return _mixed(spark, d, "shares")[0]


@query
def p9_shares(spark, d):
    one, other = (mixing.share_report(*_mixed(spark, d, keep)).withColumn("keep", F.lit(keep)) for keep in ("size", "shares"))
    return one.unionByName(other)


SQL["p3_found"] = f"""select distinct doc_id from raw_examples e left join piece_limits l on l.domain = coalesce(e.domain, 'unknown')
where doc_id is not null and regexp_matches(text, '[^{SPACE}]') and length(text) > coalesce(l.max_chars, (select max_chars from piece_limits where domain = 'unknown'))"""

_TRIMMED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '')"
SQL["p5_found"] = f"""with c as (select list(distinct word) as common from common_words),
t as (select source_record_id, source_id, text, {_TRIMMED} as lines, regexp_extract_all(text, '[{WORD_CHAR}]+') as runs from raw_records where source_record_id is not null and regexp_matches(text, '[^{SPACE}]')),
u as (select *, list_transform(runs, lambda x: lower(x)) as low from t),
s as (select source_record_id, source_id, length(regexp_replace(text, '[{WORD_CHAR}{SPACE}]', '', 'g')) / length(text)::double as symbols,
  1 - len(list_distinct(lines)) / len(lines)::double as repeated, coalesce(length(array_to_string(runs, '')) / nullif(len(runs), 0)::double, 0) as mean,
  coalesce(len(list_distinct(low)) / nullif(len(low), 0)::double, 0) as uniq, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…]["''”’»)\\]]*$'))) / len(lines)::double as ends,
  coalesce(len(list_filter(low, lambda x: list_contains(common, x))) / nullif(len(low), 0)::double, 0) as shared from u, c)
select distinct source_record_id from s join quality_policy p using (source_id) where symbols > max_symbol_ratio or repeated > max_repeated_line_ratio or mean < min_mean_word_length
  or mean > max_mean_word_length or uniq < min_unique_word_ratio or (ends < min_line_end_ratio and shared < min_common_word_ratio)"""
