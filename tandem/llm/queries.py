"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tandem.llm import bpe, conversations, decontamination, exact, packing, quality, runs, setsketch, sharding, suffixes, syncmers, toxicity, warc
from tandem.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bpe.BytePairs.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents"), pairs)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repairs(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "documents"), edit=runs.repeat_tail)


def queries() -> dict[str, Query]:
    made = [op1_suffix_array, op2_sharding, op3_packing, op4_syncmers, op5_warc, op6_setsketch, op7_exact_dedup,
            op8_rule_ensemble, op9_byte_bpe, op10_toxicity, op11_decontamination,
            op12_conversation_repair, op13_periodic_runs]
    return {query.__name__: query for query in made}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


ORACLES = {
    "op1_suffix_array": """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
bytes as (select doc_id, b, octet_length(b) as n, unnest(range(1, octet_length(b) + 1)) as i from d),
strings as (select doc_id, i, case when i + 99 <= n then b[i:i+99] end as s, b[i:i] as own from bytes),
starts as (
    select doc_id, i, own, s is not null and row_number() over (partition by s order by doc_id, i) > 1 as repeated from strings),
reached as (
    select doc_id, i, own, coalesce(
        max(case when repeated then i end) over (partition by doc_id order by i rows unbounded preceding) >= i - 99, false) as gone
    from starts),
marked as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from reached),
cut as (
    select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans,
    sha256(unhex(coalesce(string_agg(hex(own), '' order by i) filter (not gone), ''))) as kept_sha256 from marked group by doc_id)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join cut using (doc_id)""",
    "op5_warc": """
with payloads as (
    select page_id, encode(coalesce(html, '')) as payload from pages),
sized as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from payloads),
firsts as (select payload_digest, min(page_id) as first from sized where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
    case when first < page_id then 'revisit' else 'response' end as record_type,
    case when first < page_id then first end as refers_to
from sized left join firsts using (payload_digest)""",
    "op6_setsketch": r"""
with recursive words as (
    select doc_id, list_filter(
        regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'),
        lambda w: w <> '') as ws from documents),
sets as (
    select doc_id, case when len(ws) = 0 then []
        when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
        end as shingles from words),
sizes as (select doc_id, len(shingles) as n from sets),
entries as (select doc_id, unnest(shingles) as x from sets),
common as (
    select a.doc_id as u, b.doc_id as v, count(*) as c
    from entries a join entries b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (
    select u, v from common join sizes a on a.doc_id = u join sizes b on b.doc_id = v
    where 100 * c >= 85 * (a.n + b.n - c)),
reach as (
    select doc_id, doc_id as root from sizes
    union select l.v, r.root from reach r join links l on l.u = r.doc_id),
components as (select doc_id, min(root) as component_id from reach group by doc_id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept
from sizes join components using (doc_id)""",
    "op7_exact_dedup": r"""
with rows as (
    select doc_id, length(coalesce(text, '')) as n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents),
groups as (
    select content, count(*) as group_size,
        (array_agg(doc_id order by n desc, doc_id))[1] as keep_id from rows group by content)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256
from rows join groups using (content)""",
    "op11_decontamination": r"""
with doc_words as (
    select doc_id, list_filter(
        regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda w: w <> '') as ws from documents),
item_words as (
    select item_id, list_filter(
        regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda w: w <> '') as ws from benchmark),
windows as (
    select distinct item_id, size, ws[i : i + size - 1] as win from (
        select item_id, ws, least(len(ws), 10) as size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i
        from item_words where len(ws) > 0)),
sizes as (select distinct size from windows),
places as (
    select doc_id, size, i, ws[i : i + size - 1] as win from (
        select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as i from doc_words, sizes where len(ws) >= size)),
hits as (select doc_id, i, size, item_id from places join windows using (size, win)),
covered as (
    select doc_id, count(distinct place) as n_hit from (
        select doc_id, unnest(range(i, i + size)) as place from (select distinct doc_id, i, size from hits)) group by doc_id),
named as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (
        select distinct doc_id, item_id::varchar as item from hits where item_id is not null) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join covered using (doc_id) left join named using (doc_id)""",
    "op12_conversation_repair": r"""
with recursive crc_table as (
    select list_transform(range(256), lambda i:
        list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) as crc),
dice as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
                string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::bigint)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 as die
    from conversations, crc_table),
damaged as (
    select conv_id, turn, case when die = 4 then 'user' else role end as role,
        case when die = 1 then '' when die = 2 then translate(text, '.!?', '') else text end as text,
        unnest(range(case when die = 0 then 0 when die = 3 then 2 else 1 end)) as copy from dice),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from damaged),
judged as (
    select *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body,
        row_number() over (partition by conv_id, role, text order by i) > 1 as again,
        lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
faulty as (
    select *, case when body = '' then 'blank' when again then 'duplicate'
        when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from judged),
counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal,
        count(*) as n from faulty group by conv_id),
inserts(p, t, cost, edits, made) as (values
    ('-', '-', 0, '', []), ('-', 'u', 3, 'I', ['user:']), ('-', 'a', 6, 'II', ['user:', 'assistant:']),
    ('s', 's', 0, '', []), ('s', 'u', 3, 'I', ['user:']), ('s', 'a', 6, 'II', ['user:', 'assistant:']),
    ('u', 'u', 0, '', []), ('u', 'a', 3, 'I', ['assistant:']), ('u', 'u', 6, 'II', ['assistant:', 'user:']),
    ('a', 'a', 0, '', []), ('a', 'u', 3, 'I', ['user:']), ('a', 'a', 6, 'II', ['user:', 'assistant:'])),
edits(t, q, edit, cost) as (values
    ('-', '-', 'D', 4), ('s', 's', 'D', 4), ('u', 'u', 'D', 4), ('a', 'a', 'D', 4), ('-', 's', 'K', 0),
    ('-', 'u', 'K', 0), ('s', 'u', 'K', 0), ('a', 'u', 'K', 0), ('u', 'a', 'K', 0),
    ('-', 'u', 'R', 3), ('s', 'u', 'R', 3), ('a', 'u', 'R', 3), ('u', 'a', 'R', 3)),
best as (
    select conv_id, 0::bigint as i, '-' as state, {'cost': 0::bigint, 'audit': '', 'made': []::varchar[]} as way
    from (select distinct conv_id from conversations)
    union all
    select b.conv_id, f.i, e.q, min({
        'cost': b.way.cost + n.cost + e.cost + case when e.edit <> 'D' and f.fault = 'truncated' then 3 else 0 end,
        'audit': b.way.audit || n.edits || e.edit,
        'made': b.way.made || n.made || case e.edit when 'D' then [] when 'K' then [f.role || ':' || f.text]
            else [case e.q when 'u' then 'user:' else 'assistant:' end || f.text] end})
    from best b join faulty f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1
    join inserts n on n.p = b.state join edits e on e.t = n.t
    where (e.edit = 'D' or f.fault not in ('blank', 'duplicate')) and (e.edit <> 'K' or left(f.role, 1) = e.q)
    group by b.conv_id, f.i, e.q),
ended as (
    select b.conv_id, min({'cost': way.cost + case state when 's' then 6 when 'u' then 3 else 0 end,
        'audit': way.audit || case state when 's' then 'II' when 'u' then 'I' else '' end,
        'made': way.made || case state when 's' then ['user:', 'assistant:'] when 'u' then ['assistant:'] else [] end}) as way
    from best b left join counted c on c.conv_id is not distinct from b.conv_id
    where b.i = coalesce(c.n, 0) group by b.conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, way.cost as cost, way.audit as audit,
    sha256(array_to_string(way.made, chr(10))) as repaired_sha256
from ended e left join counted c on c.conv_id is not distinct from e.conv_id""",
    "op13_periodic_runs": r"""
with crc_table as (
    select list_transform(range(256), lambda i:
        list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) as crc),
texts as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) as h
    from documents, crc_table),
edits as (select *, len(ws) as n, h // 10 as g, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from texts),
edited as (
    select doc_id, n, case when a is null then ws else list_transform(range(n), lambda i:
        ws[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) end as ws from edits),
words as (select doc_id, n, unnest(ws) as w, unnest(range(n)) as i from edited),
equal as (
    select x.doc_id, y.i - x.i as q, x.i from words x join words y
    on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 2 * (y.i - x.i) <= x.n),
stretches as (
    select doc_id, q, min(i) as s, count(*) + q as length from (
        select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from equal)
    group by doc_id, q, island having count(*) + q >= greatest(12, 2 * q)),
found as (select doc_id, s, length, min(q) as q from stretches group by doc_id, s, length),
per_doc as (
    select doc_id, count(*) as n_runs, min({'l': -length, 's': s, 'q': q}) as best,
        sha256(string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q)) as runs_sha256
    from found group by doc_id),
dropped as (select distinct doc_id, unnest(range(s + q, s + length)) as i from found),
kept as (
    select doc_id, string_agg(w, ' ' order by i) as text from words anti join dropped using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, -best.l as length, best.q as period,
    (-best.l * 1000) // best.q as exponent_milli, coalesce(runs_sha256, sha256('')) as runs_sha256,
    sha256(coalesce(kept.text, '')) as collapsed_sha256
from edited left join per_doc using (doc_id) left join kept using (doc_id)""",
}
