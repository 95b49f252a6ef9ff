"""Cleaning, deduplication, splitting and publishing of the documents and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.operators import dedup, gates
from siltstone.plans.registry import query
from siltstone.runtime import cut, spread, table
from siltstone.sources import lake

S, W = T.SPACE, T.WORD_CHAR
R6 = lambda c: F.round(c, 6)
_trim = lambda x: f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"
_lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"
_words = f"regexp_extract_all(text, '[{W}]+')"
_low = f"regexp_extract_all(lower(text), '[{W}]+')"
_tokens = f"len(regexp_extract_all(text, '[^{S}]+'))"
_symbols = f"case when length(text) = 0 then 1.0 else length(regexp_replace(text, '[{W}{S}]', '', 'g')) / length(text)::double end"
_repeated = f"case when len({_lines}) < 2 then 0.0 else 1.0 - len(list_distinct({_lines})) / len({_lines})::double end"
_mean = f"case when len({_words}) = 0 then 0.0 else length(array_to_string({_words}, '')) / len({_words})::double end"
_unique = f"case when len({_low}) = 0 then 0.0 else len(list_distinct({_low})) / len({_low})::double end"
# words with other letters or digits become a 0, so that RE2's ASCII word boundaries fall where Unicode's do
_asciiwords = f"regexp_extract_all(regexp_replace(lower(text), '[{W}]*(?:[^\\P{{L}}a-z]|[\\p{{N}}_])[{W}]*', '0', 'g'), '\\b[a-z'']+\\b')"
_stop = ", ".join(f"'{w}'" for w in T.ENGLISH_STOPWORDS)
_ratio = f"coalesce(len(list_filter({_asciiwords}, lambda w: list_contains([{_stop}], w))) / nullif(len({_asciiwords}), 0)::double, 0.0)"
_score = f"least({_ratio} / 0.25, 1.0)"
_length_reason = f"case when length(text) < 200 then 'too_short_chars' when {_tokens} < 50 then 'too_short_tokens' when {_tokens} > 20000 then 'too_long_tokens' end"
_quality_reason = f"case when {_symbols} > 0.20 then 'high_symbol_ratio' when {_repeated} > 0.30 then 'repetitive_lines' when not ({_mean} between 2.5 and 12.0) then 'anomalous_word_length' when {_unique} < 0.20 then 'low_lexical_diversity' end"
_schema_reason = f"case when doc_id is null or text is null or {_trim('text')} = '' then 'empty_or_unidentified' end"
_reason = f"coalesce({_schema_reason}, {_length_reason}, case when lang is null or lang <> 'en' then 'language' end, {_quality_reason})"
_split = lambda g: f"case when ('0x' || substr(sha256({g} || '{H.SALT}'), 1, 8))::bigint % 10000 < 8000 then 'train' when ('0x' || substr(sha256({g} || '{H.SALT}'), 1, 8))::bigint % 10000 < 9000 then 'val' else 'test' end"


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def raw_records(spark, d):
    return spread(table(spark, d, "raw_records"))


def judged(spark, d):
    """documents with ``reject_reason``: the lang column as upstream language of score 1."""
    return documents(spark, d).withColumn("reject_reason", gates.reject_reason(F.col("doc_id"), F.col("text"), F.col("lang"), F.lit(1.0)))


@query(f"select doc_id, {_tokens} as tokens, round({_symbols}, 6) as symbol_ratio, round({_repeated}, 6) as repeated_line_ratio, round({_mean}, 6) as mean_word_length, round({_unique}, 6) as unique_word_ratio from documents where text is not null")
def text_scalars(spark, d):
    t = F.col("text")
    return documents(spark, d).where("text is not null").select("doc_id", T.token_count(t).alias("tokens"), R6(T.symbol_ratio(t)).alias("symbol_ratio"), R6(T.repeated_line_ratio(t)).alias("repeated_line_ratio"), R6(T.mean_word_length(t)).alias("mean_word_length"), R6(T.unique_word_ratio(t)).alias("unique_word_ratio"))


@query(f"select source_record_id, acquired_at, length(x) as n_chars, sha256(x) as sha from (select source_record_id, epoch_us(acquired_at) as acquired_at, translate(text, '{T.INVISIBLE}', '') as x from raw_records where text is not null)")
def text_strip_invisible(spark, d):
    x = T.strip_invisible(F.col("text"))
    return raw_records(spark, d).where("text is not null").select("source_record_id", F.unix_micros("acquired_at").alias("acquired_at"), F.length(x).alias("n_chars"), F.sha2(x, 256).alias("sha"))


@query(f"select source_record_id, epoch_us(acquired_at) as acquired_at, sha256(translate(text, '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}')) as sha from raw_records where text is not null")
def text_fold_confusables(spark, d):
    return raw_records(spark, d).where("text is not null").select("source_record_id", F.unix_micros("acquired_at").alias("acquired_at"), F.sha2(T.fold_confusables(F.col("text")), 256).alias("sha"))


_collapsed = "array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \\t\\x{A0}\\x{2000}-\\x{200A}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: " + _trim("x") + "), chr(10))"


@query(f"select source_record_id, epoch_us(acquired_at) as acquired_at, sha256({_trim(_collapsed)}) as sha from raw_records where text is not null")
def text_collapse_whitespace(spark, d):
    return raw_records(spark, d).where("text is not null").select("source_record_id", F.unix_micros("acquired_at").alias("acquired_at"), F.sha2(T.collapse_whitespace(F.col("text")), 256).alias("sha"))


_nomarkup = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', ' ', 'g')"
for _e, _s in T.ENTITIES.items():
    _nomarkup = f"replace({_nomarkup}, '{_e}', '{_s.replace(chr(39), chr(39) * 2)}')"


@query(f"select source_record_id, epoch_us(acquired_at) as acquired_at, sha256(regexp_replace({_nomarkup}, '&(?:#\\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);', ' ', 'g')) as sha from raw_records where text is not null")
def text_strip_markup(spark, d):
    return raw_records(spark, d).where("text is not null").select("source_record_id", F.unix_micros("acquired_at").alias("acquired_at"), F.sha2(T.strip_markup(F.col("text")), 256).alias("sha"))


@query(f"select doc_id, case when {_score} >= 0.5 then 'en' else 'unknown' end as language, round_even({_score}, 4) as score from documents where text is not null")
def text_language_heuristic(spark, d):
    language, score = T.heuristic_language(F.col("text"))
    return documents(spark, d).where("text is not null").select("doc_id", language.alias("language"), score.alias("score"))


@query(
    f"select detector, language, count(*) as n from (select case when upstream_language.lang is not null then 'upstream' else 'heuristic' end as detector, coalesce(upstream_language.lang, case when {_score} >= 0.5 then 'en' else 'unknown' end) as language from raw_records where text is not null) group by all"
)
def text_language_dispatch(spark, d):
    language, _, detector = T.detect_language(F.col("text"), F.col("upstream_language.lang"), F.col("upstream_language.score"))
    return raw_records(spark, d).where("text is not null").groupBy(detector.alias("detector"), language.alias("language")).agg(F.count("*").alias("n"))


@query("select doc_id, sha256(text) as content_sha256, length(text) as n from documents where text is not null")
def text_content_hash(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.length("text").alias("n"))


_grams = f"list_distinct(list_transform(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end, lambda g: ('0x' || substr(sha1(g), 1, 8))::bigint))"


@query(f"select doc_id, len(s) as n_shingles, coalesce(list_sum(s), 0)::bigint as total, coalesce(list_min(s), 0) as least from (select doc_id, {_grams} as s from (select doc_id, {_low} as w from documents where text is not null))")
def text_shingles(spark, d):
    s = F.col("s")
    return documents(spark, d).where("text is not null").select("doc_id", T.shingle_hashes(F.col("text")).alias("s")).select("doc_id", F.size(s).alias("n_shingles"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.coalesce(F.array_min(s), F.lit(0)).alias("least"))


_bul, _quo, _sho = f"len(list_filter(l, lambda x: regexp_matches(x, '^([-*•]|[0-9]+[.)])[{S}]')))", "len(list_filter(l, lambda x: regexp_matches(x, '^[\"''-]') and length(x) < 120))", "len(list_filter(l, lambda x: length(x) < 60))"
_structure = f"case when len(l) = 0 then 'prose' when {_bul} / len(l)::double > 0.3 then 'listy' when {_quo} / len(l)::double > 0.4 then 'dialogue' when len(l) > 4 and {_sho} / len(l)::double > 0.6 then 'sectioned' else 'prose' end"
_latin = f"list_filter(list_transform(regexp_extract_all(lower(text), '[{W}''-]+'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: regexp_matches(w, '^[a-z][a-z''-]+$'))"
_diff = f"len(w) / greatest(len(regexp_extract_all(text, '[.!?]+(?:[{S}]|$)')), 1) / 20.0 + coalesce(len(list_filter(w, lambda x: length(x) >= 8)) / nullif(len(w), 0)::double, 0.0) / 0.15"
_any = lambda ps: "(" + " or ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"
_genre = "case when structure = 'listy' then 'list-based guide' when structure = 'dialogue' then 'dialogue' " + " ".join(f"when {_any(ps)} then '{g}'" for g, ps in T.GENRE_RULES) + " else 'explainer' end"


@query(
    f"select doc_id, structure, difficulty, {_genre} as genre, case when {_any(T.CONVERSATIONAL)} then 'conversational' when difficulty = 'demanding' then 'formal' else 'informational' end as register from (select doc_id, text, {_structure} as structure, case when len(w) = 0 then 'moderate' when {_diff} < 1.0 then 'plain' when {_diff} < 1.8 then 'moderate' else 'demanding' end as difficulty from (select doc_id, text, {_lines} as l, {_latin} as w from documents where text is not null))"
)
def text_attributes(spark, d):
    t = F.col("text")
    base = documents(spark, d).where("text is not null").withColumn("structure", T.structure_of(t)).withColumn("difficulty", T.difficulty_of(t))
    return base.select("doc_id", "structure", "difficulty", T.genre_of(t, F.col("structure")).alias("genre"), T.register_of(t, F.col("difficulty")).alias("register"))


@query(f"select doc_id, string_agg(w, ', ' order by r) as topic from (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, min(p)) as r from (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as p from (select doc_id, {_latin} as w from documents where text is not null)) where length(w) > 3 and not list_contains([{_stop}], w) group by doc_id, w) where r <= 3 group by doc_id")
def text_topics(spark, d):
    from siltstone.operators.text_mining import top_words

    return top_words(documents(spark, d), "doc_id", 3)


@query(f"select doc_id, count(*) as n_paragraphs, sum(length(p)) as n_chars from (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n[{S}]*\\n'), lambda x: {_trim('x')}), lambda x: length(x) >= 80)) as p from documents where text is not null) group by doc_id")
def text_paragraphs(spark, d):
    p = documents(spark, d).where("text is not null").select("doc_id", F.explode(T.paragraphs_of(F.col("text"))).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("p")).alias("n_chars"))


@query(f"select bin, count(*) as n, sum(words) as words from (select {_tokens} as words, case when {_tokens} >= 1100 then 6 when {_tokens} >= 750 then 5 when {_tokens} >= 500 then 4 when {_tokens} >= 350 then 3 when {_tokens} >= 250 then 2 when {_tokens} >= 150 then 1 else 0 end as bin from documents where text is not null) group by bin")
def text_length_bins(spark, d):
    words = T.token_count(F.col("text"))
    return documents(spark, d).where("text is not null").select(words.alias("words")).groupBy(T.length_bin(F.col("words")).alias("bin")).agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@query("select doc_id, 'Write about ' || domain || ' in the manner of ' || register || '.' as prompt from (select source_record_id as doc_id, coalesce(domain, 'unknown') as domain, coalesce(register, 'informational') as register from raw_records)")
def text_render_prompt(spark, d):
    rows = raw_records(spark, d).select(F.col("source_record_id").alias("doc_id"), F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("register", F.lit("informational")).alias("register"))
    return rows.select("doc_id", T.render_template("Write about {domain} in the manner of {register}.", {"domain": F.col("domain"), "register": F.col("register")}).alias("prompt"))


@query("select n, sum(valid) as valid from (select o_orderkey, 16 as n, case when list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 1 then (case when substr(d, i, 1)::int > 4 then substr(d, i, 1)::int * 2 - 9 else substr(d, i, 1)::int * 2 end) else substr(d, i, 1)::int end)) % 10 = 0 then 1 else 0 end as valid from (select o_orderkey, lpad((o_orderkey * 7919 + 4000000000000000)::bigint::varchar, 16, '0') as d from orders)) group by n")
def text_luhn(spark, d):
    digits = F.lpad((F.col("o_orderkey") * 7919 + F.lit(4000000000000000)).cast("string"), 16, "0")
    return table(spark, d, "orders").groupBy(F.length(digits).alias("n")).agg(F.count_if(T.luhn_valid(digits)).alias("valid"))


@query()
def text_pii_kinds(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", F.array_join(T.pii_kinds(F.col("text")), ",").alias("kinds"))


@query()
def text_redacted(spark, d):
    from siltstone.functions.python_udfs import redact

    r = documents(spark, d).where("text is not null").select("doc_id", redact("text").alias("r"))
    return r.select("doc_id", F.sha2("r.text", 256).alias("sha"), F.array_join("r.kinds", ",").alias("kinds"))


@query()
def text_normalized(spark, d):
    from siltstone.functions.python_udfs import normalize

    return raw_records(spark, d).where("text is not null").select("source_record_id", "acquired_at", F.sha2(normalize("text"), 256).alias("canonical_sha256"))


# ---- gates ----
@query(f"select coalesce(reason, 'kept') as reason, count(*) as n from (select {_reason} as reason from documents) group by reason")
def gates_reject_reasons(spark, d):
    return gates.cleaning_stats(judged(spark, d))


@query(f"select source, coalesce(reason, 'kept') as reason, count(*) as n from (select source, {_reason} as reason from documents) group by all")
def gates_stats_by_source(spark, d):
    return gates.cleaning_stats(judged(spark, d), "source")


@query(f"select reason, sum(n)::bigint as n from (select source, coalesce(reason, 'kept') as reason, count(*) as n from (select source, {_reason} as reason from documents) group by all) group by reason")
def gates_merged_stats(spark, d):
    return gates.merge_stats(gates.cleaning_stats(judged(spark, d), "source"))


@query(f"select count(*) as seen, count(*) filter (reason is null) as kept, round_even(count(*) filter (reason is null) / count(*)::double, 4) as keep_rate from (select {_reason} as reason from documents)")
def gates_keep_rate(spark, d):
    return gates.keep_rate(judged(spark, d))


@query(f"select count(*) filter (not (t between 50 and 20000)) as n_outside, min(t) as least, max(t) as most from (select {_tokens} as t from documents where {_reason} is null)")
def gates_policy_check(spark, d):
    kept = judged(spark, d).where("reject_reason is null").select(T.token_count(F.col("text")).alias("tokens"))
    return gates.policy_violations(kept, "tokens")


# ---- deduplication ----
_kept = f"(select doc_id, source, sha256(text) as sha from documents where {_reason} is null)"


@query(f"select doc_id, case when doc_id <> m then m end as duplicate_of from (select doc_id, min(doc_id) over (partition by sha) as m from {_kept})")
def dedup_exact_first_wins(spark, d):
    kept = judged(spark, d).where("reject_reason is null").select("doc_id", F.sha2("text", 256).alias("sha"))
    return dedup.exact_first_wins(kept, "sha", "doc_id").select("doc_id", "duplicate_of")


@query("select sha256(text) as sha, min(doc_id) as survivor, count(*) - 1 as duplicates from documents where text is not null group by sha")
def dedup_exact_survivors(spark, d):
    return dedup.exact_survivors(documents(spark, d).select("doc_id", F.sha2("text", 256).alias("sha")), "sha", "doc_id")


@query("select sha256(text) as sha, min(id) as survivor, count(*) - 1 as duplicates from (select 'd' || doc_id as id, text from documents union all select 'e' || doc_id, text from raw_examples union all select 'r' || source_record_id, text from raw_records) where text is not null group by sha")
def dedup_across_sources(spark, d):
    pick = lambda name, key, p: table(spark, d, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.sha2("text", 256).alias("sha"))
    return dedup.exact_survivors(pick("documents", "doc_id", "d").unionByName(pick("raw_examples", "doc_id", "e")).unionByName(pick("raw_records", "source_record_id", "r")), "sha", "id")


def _first_wins(spark, d):
    kept = judged(spark, d).where("reject_reason is null").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    own = cut(dedup.exact_first_wins(kept, "sha", "doc_id").where("duplicate_of is null").select("doc_id", "text"))
    pairs = dedup.banded_pairs(dedup.signatures(own, "doc_id", "text"))
    return dedup.first_wins(own.select(F.col("doc_id").alias("id")), pairs)


@query()
def dedup_near_first_wins(spark, d):
    return _first_wins(spark, d).withColumnRenamed("id", "doc_id")


@query()
def dedup_minhash_signatures(spark, d):
    return dedup.signatures(documents(spark, d), "doc_id", "text").select(F.col("id").alias("doc_id"), F.slice("sig", 1, 4).alias("head"), F.xxhash64("sig").alias("whole"))


@query(
    "with h as (select c_custkey as id, floor(c_custkey / 40)::bigint as g, xor(('0x' || substr(sha256((floor(c_custkey / 40)::bigint)::varchar), 1, 15))::bigint, 1::bigint << (c_custkey % 59)::int) as h from customer) select x.id as a, y.id as b, bit_count(xor(x.h, y.h))::int as distance from h x join h y on x.g = y.g and x.id < y.id where bit_count(xor(x.h, y.h)) <= 6"
)
def dedup_hamming(spark, d):
    g = F.floor(F.col("c_custkey") / 40).cast("long")
    h = H.hex_number(F.sha2(g.cast("string"), 256), 15).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("c_custkey"), F.lit(59)).cast("int")))
    return dedup.hamming_pairs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), h.alias("hash")))


@query("with p as (select distinct doc_id, split, sha256(text) as sha from raw_examples where text is not null and split is not null), d as (select doc_id, sha, min(doc_id) over (partition by sha) as m from p where split <> 'train'), t as (select distinct sha from p where split = 'train') select case when t.sha is not null then 'overlaps_training' when d.doc_id <> d.m then 'duplicate' else 'written' end as outcome, count(*) as n from d left join t on d.sha = t.sha group by 1")
def join_training_overlap(spark, d):
    """Outcome of writing the rows of other splits beside the protected training texts."""
    rows = table(spark, d, "raw_examples").where("text is not null and split is not null").select("doc_id", "split", F.sha2("text", 256).alias("sha")).distinct()
    return dedup.overlap_report(rows.where("split <> 'train'").select("doc_id", "sha"), rows.where("split = 'train'"), "sha", "doc_id")


@query(
    "with recursive h as (select c_custkey as id, xor(('0x' || substr(sha256((floor(c_custkey / 40)::bigint)::varchar), 1, 15))::bigint, 7::bigint << (c_custkey % 59)::int) as h, row_number() over (partition by floor(c_custkey / 40) order by c_custkey) as i, floor(c_custkey / 40) as g from customer), f as (select g, i, [{'id': id, 'h': h}] as kept, id, null::bigint as best from h where i = 1 "
    "union all select h.g, h.i, case when len(list_filter(f.kept, lambda k: bit_count(xor(k.h, h.h)) <= 4)) > 0 then f.kept else list_append(f.kept, {'id': h.id, 'h': h.h}) end, h.id, list_sort(list_transform(list_filter(f.kept, lambda k: bit_count(xor(k.h, h.h)) <= 4), lambda k: bit_count(xor(k.h, h.h))::bigint * 1000000000 + k.id))[1] % 1000000000 from f join h on h.g = f.g and h.i = f.i + 1) select id, best as duplicate_of from f"
)
def dedup_hamming_first_wins(spark, d):
    g = F.floor(F.col("c_custkey") / 40).cast("long")
    h = H.hex_number(F.sha2(g.cast("string"), 256), 15).bitwiseXOR(F.call_function("shiftleft", F.lit(7).cast("long"), F.pmod(F.col("c_custkey"), F.lit(59)).cast("int")))
    return dedup.hamming_first_wins(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), h.alias("hash")), 4)


# ---- splits and the whole slice ----
@query(f"select {_split(chr(39) + 'grp_' + chr(39) + ' || doc_id')} as split, count(*) as n from documents where doc_id is not null group by split")
def split_counts(spark, d):
    return documents(spark, d).where("doc_id is not null").groupBy(H.split_of_group(H.group_id(F.col("doc_id"))).alias("split")).agg(F.count("*").alias("n"))


@query(
    f"select split, outcome, count(*) as n, sum(n_tokens)::bigint as n_tokens from (select case when reason is null then {_split(chr(39) + 'grp_' + chr(39) + ' || doc_id')} else 'none' end as split, coalesce(reason, case when doc_id <> m then 'exact_duplicate' else 'kept' end) as outcome, n_tokens from (select doc_id, reason, n_tokens, min(case when reason is null then doc_id end) over (partition by sha) as m from (select doc_id, coalesce(sha256(text), '') as sha, {_reason} as reason, coalesce({_tokens}, 0) as n_tokens from documents))) group by all"
)
def pipeline_minimum_slice(spark, d):
    # the gates run once; what both uses of the result need is a few narrow columns
    rows = cut(judged(spark, d).select("doc_id", "reject_reason", F.sha2("text", 256).alias("sha"), F.coalesce(T.token_count(F.col("text")), F.lit(0)).alias("n_tokens")))
    first = rows.where("reject_reason is null").groupBy("sha").agg(F.min("doc_id").alias("first"))
    kept = F.col("reject_reason").isNull()
    split = F.when(kept, H.split_of_group(H.group_id(F.col("doc_id")))).otherwise("none")
    outcome = F.coalesce("reject_reason", F.when(F.col("doc_id") != F.col("first"), "exact_duplicate").otherwise("kept"))
    return rows.join(first, "sha", "left").groupBy(split.alias("split"), outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"))


@query()
def pipeline_clean_corpus(spark, d):
    """Normalise, redact, gate, deduplicate (exact and near) and split the raw records, ready to write."""
    from siltstone.plans.ingest import clean

    return clean(raw_records(spark, d)).select("doc_id", "source", "split", "token_count", "content_sha256", "pii_flags", "redistributable")


# ---- manifests ----
@query(f"select source, count(*) as n_docs, sha256(string_agg(doc_id::varchar, chr(10) order by doc_id::varchar)) as ids_sha256 from documents where source is not null and text is not null group by source")
def manifest_by_source(spark, d):
    from siltstone.sources.lake import manifest

    return manifest(documents(spark, d).where("text is not null"), "source", "doc_id")


@query(f"select substr(sha256(string_agg(doc_id || chr(9) || sha256(text) || chr(9) || {_split(chr(39) + 'grp_' + chr(39) + ' || doc_id')} || chr(10), '' order by doc_id || chr(9) || sha256(text))), 1, 16) as fingerprint, count(*) as n from documents where text is not null")
def manifest_fingerprint(spark, d):
    from siltstone.sources.lake import fingerprint

    rows = documents(spark, d).where("text is not null").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.sha2("text", 256), H.split_of_group(H.group_id(F.col("doc_id")))).alias("line"))
    return fingerprint(rows, "line")


@query("select ('0x' || substr(sha256(text), 1, 8))::bigint % 16 as shard, count(*) as n, min(doc_id) as first, max(doc_id) as last from documents where text is not null group by shard")
def manifest_shards(spark, d):
    from siltstone.sources.lake import shard_of

    return documents(spark, d).where("text is not null").groupBy(shard_of(F.sha2("text", 256), 16).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("select source_record_id, case when license in ('odc-by', 'public-domain') then text end as text from raw_records")
def publish_redistributable(spark, d):
    from siltstone.sources.lake import redistributable_view

    return redistributable_view(raw_records(spark, d), F.col("license").isin("odc-by", "public-domain")).select("source_record_id", "text")


@query("select source_record_id, license, domain, length(text) as n from raw_records where coalesce(license not in ('odc-by', 'public-domain'), true)")
def publish_metadata_only(spark, d):
    rows = raw_records(spark, d).withColumn("n", F.length("text"))
    return lake.metadata_only(rows, F.col("license").isin("odc-by", "public-domain")).select("source_record_id", "license", "domain", "n")
