"""Registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import audit, bpe, chat, licenses, packing, quality, rangejoin, secrets, simhash, toxicity, trie, warc, wrapper

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def wrap(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_chat_snapshots")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(table(spark, folder, "conversations"))


@_query("op2_toxic_spans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op3_embedding_range_join", """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where e is not null and list_count(e) = len(e) and len(list_filter(e, lambda x: not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
nm as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from ok),
k as (select a.vec_id as a, b.vec_id as b from nm a join nm b on a.vec_id <> b.vec_id
  and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, k.b from reach r join k on k.a = r.b),
comp as (select a as vec_id, min(b) as component_id from reach group by a),
cnt as (select a as vec_id, count(*) as n from k group by a)
select vec_id, coalesce(cnt.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from comp left join cnt using (vec_id)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return rangejoin.groups(table(spark, folder, "embeddings"))


@_query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = secrets.found(table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return rows.select(
        F.col("_in.doc_id").alias("doc_id"), count(0), count(1), count(2),
        F.sha2(secrets.rendered(F.col("base")), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans")).alias("spans"),
    )


@_query("op6_quality_rules", rf"""
with d as (select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as t from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
win as (select rid, i, ws[i:i+4] as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select rid, i from win qualify count(*) over (partition by rid, g) > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from rep) group by rid),
ln as (select rid, host, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as k from d),
lw as (select *, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) as y from ln
       where regexp_matches(x, '[^\x20\x09-\x0D]')),
pl as (select *, coalesce('=' || lag(y) over (partition by rid order by k), '') as a,
       coalesce('=' || lead(y) over (partition by rid order by k), '') as b from lw),
fr as (select host, y from pl group by host, y
       having count(distinct rid) > {quality.LINE_LIMIT} and count(distinct (a, b)) > {quality.LINE_LIMIT}),
gone as (select rid, count(*) as c, sum(length(pl.y)) as g from pl
         join fr on fr.host is not distinct from pl.host and fr.y = pl.y group by rid),
per as (select rid, count(*) - count(distinct x) as dup, sum(length(y)) as chars from pl group by rid),
m as (select d.doc_id, len(w.ws)::bigint as n_words,
        length(array_to_string(w.ws, ''))::bigint as word_chars,
        length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
        coalesce(per.dup, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
        coalesce(per.chars, 0) as chars, coalesce(gone.c, 0)::bigint as n_removed,
        coalesce(gone.g, 0)::bigint as removed_chars
      from d join w using (rid) left join cov using (rid) left join per using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and chars - removed_chars >= {quality.LEFT} * chars as kept,
  n_removed, removed_chars
from m""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


@_query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query("op9_warc_bundles", f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest from p),
k as (select *, max(page_id) over (partition by payload_digest) as last from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {warc.SMALL} and page_id <> last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {warc.SMALL} and page_id <> last then last end as refers_to
from k""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc.archive_folder(spark)
    index = warc.write(table(spark, folder, "pages"), archive)
    return warc.read(index, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op10_simhash_groups")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query("op4_pack_sequences")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.coded(table(spark, folder, "documents"), path, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


@_query("op11_filter_audit", r"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
least as (select t, min(doc_id) as m from d group by t),
lab as (select doc_id, max((quality = 1)::int) as g, max((toxic = 1)::int) as x from labels group by doc_id),
f as (select part, coalesce(g, 0) as g, coalesce(x, 0) as x,
    (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > m, false)::int as mask
  from d join w using (rid) join least using (t) left join lab on lab.doc_id = d.doc_id),
wm as (select part, mask, count(*) as n, sum(g) as g, sum(x) as x from f group by part, mask),
perm(o) as (select '' union all select o || c from perm, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) l where not contains(o, c)),
step as (select o as filter_order, k as step, 1 << (instr('ABCDE', substr(o, k, 1)) - 1) as bit,
    list_sum([1 << (instr('ABCDE', c) - 1) for c in string_split(substr(o, 1, k - 1), '') if c <> '']) as before
  from (select o from perm where length(o) = 5) p, (select unnest(range(1, 6))::int as k) q),
raw as (select part, filter_order, step, bit,
    sum(case when mask & (bit | coalesce(before, 0)::int) = 0 then n else 0 end) as kept,
    sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int = 0 then n else 0 end) as removed,
    sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int = 0 then g else 0 end) as good_lost,
    sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int = 0 then x else 0 end) as toxic_lost
  from wm, (select filter_order, step, bit::int as bit, before from step) s group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from raw""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    failed = audit.failures(table(spark, folder, "documents"))
    return audit.audit(audit.weighted_masks(failed, table(spark, folder, "labels")))


# CRC-32 of the decimal digits of an id: eight shifts a byte, reflected polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@_query("op12_prefix_trie", rf"""
with t as (select conv_id, turn, coalesce(text, '') as text,
    sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) as d from conversations where conv_id is not null),
c as (select conv_id, list(d order by turn nulls first, d) as ds,
    list(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) order by turn nulls first, d) as ws
  from t group by conv_id),
h as (select *, ({_CRC.format("conv_id::varchar")} % 4)::int as h from c),
r as (select h.conv_id, list_concat(coalesce(s.ds[1:h.h], []), h.ds[h.h + 1:]) as ds, list_concat(coalesce(s.ws[1:h.h], []), h.ws[h.h + 1:]) as ws
  from h left join c s on s.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, len(ds) as n, k, ds[1:k] as key, case when k = 0 then 0 else ws[k] end as w from (select *, unnest(range(0, len(ds) + 1)) as k from r)),
n as (select key, k as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = k), '') as ends from p group by key, k),
f as (select a.key, count(*) filter (b.depth = a.depth + 1) as n_children, sum((b.n_convs - 1) * b.w) as saved,
    count(*) filter (not exists (select 1 from n c where c.depth = b.depth + 1 and c.key[1:b.depth] = b.key)) as leaves
  from n a join n b on b.depth >= a.depth and b.key[1:a.depth] = a.key group by a.key)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, f.n_children, f.leaves as n_leaves,
  f.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from n join f using (key) left join n u on u.depth = n.depth - 1 and u.key = n.key[1:n.depth - 1]""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.placed_turns(table(spark, folder, "conversations"))))


_LICENSE_LABELS = ", ".join(
    f"case when regexp_matches(s, ' {licenses.pattern(licenses.parse(markup))}') then '{label}' end"
    for label, markup in licenses.TEMPLATES
)
_LICENSE_PHRASES = ", ".join(
    f"[{{'label': '{label}', 'word': i}} for i in range(0, len(ws)) if ws[i + 1:i + {len(p.split())}] = {p.split()}]"
    for p, label in licenses.PHRASES.items()
)


@_query("op13_license_scan", rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
j as (select rid, doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' as s from d),
p as (select rid, doc_id, ws, flatten([{_LICENSE_PHRASES}]) as named, list_filter([{_LICENSE_LABELS}], lambda x: x is not null) as accepted from j),
l as (select *, [x.label for x in named] as names, [x.word for x in named] as starts from p)
select doc_id, len(ws)::bigint as n_words, len(named)::bigint as n_base, list_min(starts)::bigint as first_word, list_max(starts)::bigint as last_word,
  array_to_string(list_sort(list_distinct(names)), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(names, accepted))), ',') as labels,
  case when len(accepted) > 0 then {licenses.WHOLE}::double when len(named) > 0 then {licenses.NAMED}::double else 0::double end as score
from l""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, folder, "documents")))
