"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrorfold.llm import (
    boosted_trees, bpe, chat, decontamination, fuzzy_passages, merkle, packing, periodic, quality_rules, secret_scan, sharding,
    simhash, warc)
from mirrorfold.llm.common import table
from mirrorfold.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_balanced_shards(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query
def op2_quality_classifier(spark, folder):
    return boosted_trees.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_quality_rules(spark, folder):
    judged = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))


# The counts, then per stratum and rule the cutoffs in order from the loosest, the exact binomial
# tail of what each would lose, and the best of those before the first that fails.
ORACLE["op3_quality_rules"] = r"""
with docs as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents),
split as (
    select r, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs),
starts as (
    select r, unnest(range(len(w) - 4)) as s, unnest(list_transform(range(len(w) - 4), lambda i: w[i + 1:i + 5])) as g
    from split where len(w) > 4),
again as (select r, s from starts qualify count(*) over (partition by r, g) > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(s, s + 5)) as p from again) group by r),
counted as (
    select split.r, doc_id, lang, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
    from split left join covered using (r)),
placed as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        3 * coalesce(list_position(['de', 'en', 'es', 'fr'], lang) - 1, 4) + (n_words >= 100)::int + (n_words >= 1000)::int as stratum
    from counted),
ratios as (
    select r, doc_id, stratum, base_failed, unnest(['symbols', 'repeated_lines', 'repeated_words', 'word_length']) as rule,
        unnest(list_transform([n_symbols, n_dup_lines, n_repeat_words, word_chars],
                              lambda x: 1000 * x // greatest(n_words, 1))) as ratio from placed),
voted as (
    select doc_id, avg(quality) >= 0.5 as good from labels where doc_id is not null and quality is not null group by doc_id),
held as (select stratum, rule, ratio, good from ratios join voted using (doc_id) where not base_failed),
grid as (select unnest([0, 1, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300, 400, 600, 800, 1000, 1500, 2000, 3000, 5000, 8000,
    12000, 20000]) as cutoff),
tested as (
    select stratum, rule, cutoff, count(*) filter (good) as n, count(*) filter (good and ratio > cutoff) as lost,
        count(*) filter (not good and ratio > cutoff) as caught from held, grid group by all),
tails as (
    select *, case when n = 0 or lost >= n then 1.0 else list_sum(list_transform(range(lost + 1), lambda i: exp(
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(1 - 0.0125)))) end as tail from tested),
certified as (
    select *, caught - 20 * lost as worth from tails
    qualify bool_and(tail <= 0.05 / 60) over (partition by stratum, rule order by cutoff desc)),
chosen as (
    select stratum, rule, arg_max(cutoff, (worth, cutoff)) as cutoff from certified where worth > 0 group by stratum, rule),
hits as (
    select r, string_agg(rule, ',' order by list_position(['symbols', 'repeated_lines', 'repeated_words', 'word_length'], rule))
        as rejected_by from ratios join chosen using (stratum, rule) where ratio > cutoff group by r)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
    not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by
from placed left join hits using (r)"""


@query
def op5_simhash_groups(spark, folder):
    return simhash.near_duplicate_groups(table(spark, folder, "documents"))


@query
def op6_bpe_round_trip(spark, folder):
    return bpe.round_trip_digests(table(spark, folder, "documents"), tokenizer_path())


@query
def op4_benchmark_leaks(spark, folder):
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_repeated_passages(spark, folder):
    return fuzzy_passages.repeated_passages(table(spark, folder, "documents"))


@query
def op8_warc_salvage(spark, folder):
    return warc.archive_pages(table(spark, folder, "pages"), f"{scratch(spark, 'warc')}/archives")


ORACLE["op8_warc_salvage"] = """
with paged as (
    select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as response_id from pages),
hashed as (select page_id, response_id, strlen(html) as n, sha1(html) as h from paged)
select page_id, cast(n as bigint) as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
        (cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31
        as bigint), 1)), '') as payload_digest,
    case when page_id = response_id then 'response' else 'revisit' end as record_type,
    case when page_id <> response_id then response_id end as refers_to
from hashed"""


@query
def op9_secret_scan(spark, folder):
    return secret_scan.find_secrets(table(spark, folder, "documents"))


@query
def op10_chat_format(spark, folder):
    return chat.digests(chat.format_conversations(table(spark, folder, "conversations")))


# The control strings of the template, with the backslashes that one more is put behind.
ORACLE["op10_chat_format"] = r"""
with rows_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
    select *, length(regexp_replace(role, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
        + length('<|im_start|><|im_sep|><|im_end|>') as n from rows_)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(n) as bigint) as formatted_chars
from marked group by conv_id"""


@query
def op11_best_fit_packing(spark, folder):
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op12_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = merkle.digest_of([F.col(f) for f in fields[:-1]] + [tampered])
    rows = merkle.manifest(docs, fields, carried={"changed": changed})
    folded = merkle.fold(F.col("changed"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# Levels of each part's tree, then every leaf walks up its part's tree and the tree of parts.
ORACLE["op12_merkle_manifest"] = r"""
with recursive
noted as (
    select row_number() over () as r, doc_id, source, text,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
            4294967295) as crc
    from documents),
changed as (select *, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as other from noted),
leaves as (
    select r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        sha256(head || coalesce(strlen(other) || ':' || other, '-')) as changed from changed),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves),
tree(source, level, nodes) as (
    select source, 0, list(leaf order by place) from placed group by source
    union all
    select source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
    from tree where len(nodes) > 1),
subs as (select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as spot from tree where len(nodes) = 1),
top(level, nodes) as (
    select 0, list(subroot order by spot) from subs
    union all
    select level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))
    from top where len(nodes) > 1),
walk(r, source, place, level, node, proof, done) as (
    select r, source, place, 0, changed, '', false from placed
    union all
    select r, w.source, place // 3, w.level + 1,
        case when len(nodes) = 1 then node else sha256(array_to_string(nodes[place - place % 3 + 1:place], '') || node
            || array_to_string(nodes[place + 2:place - place % 3 + 3], '')) end,
        case when len(nodes) = 1 then proof else proof || array_to_string(nodes[place - place % 3 + 1:place], '')
            || array_to_string(nodes[place + 2:place - place % 3 + 3], '') end,
        len(nodes) = 1
    from walk w join tree t on t.source is not distinct from w.source and t.level = w.level where not done),
climb(r, place, level, node, proof, done) as (
    select r, spot, 0, node, proof, false from walk w join subs on subs.source is not distinct from w.source where done
    union all
    select r, place // 3, c.level + 1,
        case when len(nodes) = 1 then node else sha256(array_to_string(nodes[place - place % 3 + 1:place], '') || node
            || array_to_string(nodes[place + 2:place - place % 3 + 3], '')) end,
        case when len(nodes) = 1 then proof else proof || array_to_string(nodes[place - place % 3 + 1:place], '')
            || array_to_string(nodes[place + 2:place - place % 3 + 3], '') end,
        len(nodes) = 1
    from climb c join top t on t.level = c.level where not done)
select doc_id, leaf, subroot, nodes[1] as root, sha256(proof) as proof_sha256, node as folded_root, node = nodes[1] as verified
from climb join placed using (r) join subs on subs.source is not distinct from placed.source
join top on len(nodes) = 1 where done"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One text in ten, by its id, turned into a period repeated to its end."""
    hashed = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string"))).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    hashed = hashed.withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.expr("cast(if(size(_w) > 0, _g % size(_w), 0) as int)"))
    hashed = hashed.withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + _g % 8) as int)"))
    planted = F.expr("array_join(transform(_w, (w, i) -> if(i < _a, w, _w[_a + (i - _a) % _p])), ' ')")
    return hashed.withColumn("text", F.when(F.expr("_h % 10 = 0 and size(_w) > 0"), planted).otherwise(F.col("text"))).select(*docs.columns)


@query
def op13_periodic_runs(spark, folder):
    docs = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return periodic.periodic_runs(docs).withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
