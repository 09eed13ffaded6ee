"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gesso.llm import alignment, bpe, hash_tree, html_layout, mixing, pii, pivot_index, prefix_trie, quality_table, secret_scan, simhash, suffix_dedup, token_rollup
from gesso.registry import Tables, query
from gesso.session import scratch_path

TREE = hash_tree.even_tree(8)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_pii")
def op1(t: Tables) -> DataFrame:
    return pii.span_digests(t.documents)


@query("op2_html_layout")
def op2(t: Tables) -> DataFrame:
    return html_layout.extract_text(t.pages.select("page_id", "url", "html"))


OP3 = r"""
with c as (
  select source, lang, doc_id, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]'))::bigint as pieces
  from documents),
live as (select * from c where not coalesce(doc_id % 7 = 3, false)),
rows_ as (
  select source, lang, 'words-1' as tokenizer, 1::bigint as d, words as t from live
  union all
  select source, lang, 'pieces-1', 1::bigint, case when coalesce(doc_id % 5 = 1, false) then 2 * pieces else pieces end from live)
select source, lang, tokenizer, sum(d)::bigint as documents, sum(t)::bigint as tokens
from rows_ group by all having sum(d) <> 0 or sum(t) <> 0
"""


@query("op3_token_rollup", OP3)
def op3(t: Tables) -> DataFrame:
    """All documents go in; then the piece counter of every fifth is revised to double, and every seventh is deleted.

    Each batch is committed twice, as after a lost answer, and the ledger is
    folded between them.
    """
    ledger = token_rollup.Rollup(t.spark, scratch_path(t.spark, "ledger"))
    docs, counters = t.documents, token_rollup.tokenizers()
    old, new = {"pieces-1": counters["pieces-1"]}, {"pieces-1": 2 * counters["pieces-1"]}
    every = lambda n, k: F.coalesce(F.col("doc_id") % n == k, F.lit(False))
    gone = docs.where(every(7, 3))
    batches = {
        "inserts": token_rollup.counted(docs, counters),
        "revisions": token_rollup.revised(token_rollup.counted(docs.where(every(5, 1)), old), token_rollup.counted(docs.where(every(5, 1)), new)),
        "deletes": token_rollup.counted(gone, {"words-1": counters["words-1"], "pieces-1": F.when(every(5, 1), 2).otherwise(1) * counters["pieces-1"]}, -1),
    }
    for name, rows in batches.items():
        ledger.commit(name, rows)
        ledger.commit(name, rows)
        if name == "revisions":
            ledger.fold()
    return ledger.totals()


def _descent(tree, prefix: str) -> str:
    """SQL of region, rack and shard for each level of a tree, one CTE a level."""
    draw = lambda c, w: f"{{'d': -ln((('0x' || substr(md5('tree/{c}/' || key), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double) / {w!r}::double, 'c': '{c}'}}"
    out, parent, source = [], "''", prefix + "0"
    for name, level in zip(("region", "rack", "shard"), hash_tree._levels(tree), strict=True):
        cases = " ".join(
            f"when {parent} = '{node}' then " + (f"'{children[0][0]}'" if len(children) == 1 else "least(" + ", ".join(draw(c, w) for c, w in children) + ").c") for node, children in level.items()
        )
        out.append(f"{prefix}{name} as (select *, case {cases} end as {prefix}_{name} from {source})")
        parent, source = f"{prefix}_{name}", prefix + name
    return ",\n".join(out)


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


OP4 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, '') as key from documents),
t as (select {_crc_table()}::bigint[] as t),
a0 as (
  select r, doc_id, key, strlen(text) + 1 as size,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::bigint)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as crc
  from d, t),
{_descent(TREE, "a")},
b0 as (select * from ashard),
{_descent(hash_tree.grow(TREE), "b")}
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'key' as law, a_shard::int as shard,
       (row_number() over (partition by a_shard order by r) - 1)::bigint as slot, b_shard::int as grown_shard, a_region as region, a_rack as rack
from bshard
"""


@query("op4_hash_tree", OP4)
def op4(t: Tables) -> DataFrame:
    return hash_tree.shard_rows(t.documents, TREE)


OP5 = r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (
  select *, sqrt(list_inner_product(e, e)) as norm from v
  where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.98),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) as component_id from reach group by a),
deg as (select a, count(*) as n_links from links group by a)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v join low on low.a = v.vec_id left join deg on deg.a = v.vec_id
"""


@query("op5_pivot_index", OP5)
def op5(t: Tables) -> DataFrame:
    return pivot_index.near_dup_vectors(t.embeddings)


OP6 = r"""
with t as (
  select doc_id, source, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as dense from documents),
d as (
  select doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as size, md5(text) as tie,
         (length(regexp_replace(dense, '[0-9#*$%&|<>]+', '', 'g')) + 1.0::double) / (length(dense) + 1.0::double) as quality,
         (('0x' || substr(md5('mix/' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u
  from t),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w from s0),
s2 as (
  select *, 3 * source_size as stop, sum(source_size) over () as all_size, sum(w) over () as all_w,
         row_number() over o as place,
         coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as stopped,
         coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0.0::double) as stopped_w
  from s1 window o as (order by (3 * source_size)::double / w, source is null, source)),
s3 as (select *, (all_size - stopped)::double / (all_w - stopped_w) as lev from s2),
held as (select arg_min(lev, place) as lev, min(place) as place from s3 where lev * w <= stop),
s4 as (select s3.source, source_size, case when held.place is null or s3.place < held.place then stop::double else w * held.lev end as target from s3, held),
s5 as (select *, case when source_size = 0 then 0 when target >= 3 * source_size then 3 else floor(target / source_size) end as epochs from s4),
r as (
  select d.*, s5.source_size, s5.target, s5.epochs, greatest(0.0::double, target - epochs * source_size) as rest,
         sum(size) over (partition by d.source order by -ln(u) / quality, doc_id nulls first, size, tie rows unbounded preceding) as upto
  from d join s5 on d.source is not distinct from s5.source)
select doc_id, size, source_size::bigint as source_size, target::double as target,
       ((epochs + case when upto - size < rest and 2 * upto - size <= 2 * rest then 1 else 0 end) * size)::bigint as taken
from r
"""


@query("op6_mix_sources", OP6)
def op6(t: Tables) -> DataFrame:
    return mixing.mix_documents(t.documents)


@query("op7_simhash")
def op7(t: Tables) -> DataFrame:
    return simhash.simhash_near_dups(t.documents)


@query("op8_bpe")
def op8(t: Tables) -> DataFrame:
    return bpe.token_digests(t.documents, VOCABULARY)


_STOPS = ", ".join(f"'{w}'" for w in sorted(quality_table.STOP_WORDS))
_LISTED = f" and lower(substr(lang, 1, 2)) in {quality_table.LANGUAGES!r}"
_FAILS = ", ".join(
    f"case when 100 * {r.top} {'>' if r.side == 'above' else '<'} {r.percent} * {r.base} and n_words >= {r.least_words}{_LISTED if r.by_language else ''} then '{r.name}' end" for r in quality_table.RULES
)
OP9 = rf"""
with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents),
w as (
  select r, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
grams as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g
  from (select r, w, unnest(generate_series(1, len(w) - 4)) as i from w)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
cover as (select r, sum(least(5, i - before)) as n from (select r, i, lag(i, 1, i - 5) over (partition by r order by i) as before from twice) group by r),
c as (
  select w.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(cover.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
         len(list_filter(w, lambda x: lower(x) in ({_STOPS})))::bigint as n_stop_words
  from w left join cover on cover.r = w.r),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, concat_ws(',', {_FAILS}) as failed_rules from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' as kept, failed_rules from f
"""


@query("op9_quality_rules", OP9)
def op9(t: Tables) -> DataFrame:
    return quality_table.judge_documents(t.documents)


@query("op10_secrets")
def op10(t: Tables) -> DataFrame:
    return secret_scan.secret_digests(t.documents)


OP11 = """
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, hex(coalesce(text, '')) as x from documents),
parts as (
  select r, doc_id, k, substr(x, 2 * k + 1, 498) as x
  from (select r, doc_id, x, unnest(generate_series(0, (length(x) // 2 - 50)::int, 200)) as k from d where length(x) >= 100)),
w as (
  select r, coalesce(doc_id, 9223372036854775807::bigint) as place, k + i as s, md5_number(substr(x, 2 * i + 1, 100)) as window_
  from (select *, unnest(generate_series(0, least(199, length(x) // 2 - 50)::int)) as i from parts)),
c as (select window_, min(place) as low from w group by window_ having min(place) < max(place)),
g as (select r, s, s - lag(s, 1, -1000) over (partition by r order by s) as step from w join c using (window_) where low < place),
runs as (select r, s, sum(case when step > 50 then 1 else 0 end) over (partition by r order by s) as run from g),
spans as (select r, min(s) as a, max(s) + 50 as b from runs group by r, run),
ends as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from spans),
cut as (
  select ends.r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as kept, max(b) as tail
  from ends join d on d.r = ends.r group by ends.r)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(case when cut.r is null then unhex(x) else unhex(kept || substr(x, 2 * tail + 1)) end) as kept_sha256
from d left join cut on cut.r = d.r
"""


@query("op11_suffix_dedup", OP11)
def op11(t: Tables) -> DataFrame:
    return suffix_dedup.remove_repeats(t.documents)


@query("op12_token_alignment")
def op12(t: Tables) -> DataFrame:
    return alignment.align_documents(t.documents, VOCABULARY, PIECE_MODEL)


OP13 = f"""
with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as position
  from conversations where conv_id is not null),
t as (select {_crc_table()}::bigint[] as t),
ids as (
  select conv_id, conv_id - conv_id % 5 as base,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(conv_id::varchar), '..'), lambda x: ('0x' || x)::bigint)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 9 as h
  from (select distinct conv_id from o), t),
r as (
  select ids.conv_id, position, role, text from ids join o on o.conv_id = base where position < h
  union all
  select ids.conv_id, position, role, text from ids join o on o.conv_id = ids.conv_id where position >= h),
p0 as (
  select conv_id, row_number() over w as depth, string_agg(md5(strlen(role) || ':' || role || text), '') over w as path, strlen(text) as bytes
  from r window w as (partition by conv_id order by position rows unbounded preceding)),
p as (select conv_id, depth, path, bytes from p0 union all select conv_id, 0, '', 0 from ids),
n as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved from p group by path),
k as (select left(path, length(path) - 32) as path, count(*) as n_children from n where depth > 0 group by all),
s as (
  select p.path, count(*) filter (where k.path is null) as n_leaves, sum(n.saved) as saved_tokens
  from n left join k on k.path = n.path join p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.path),
e as (
  select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends
  from (select conv_id, arg_max(path, depth) as path from p group by conv_id) group by path)
select n.conv_id, n.depth::bigint as depth, q.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n_children, 0)::bigint as n_children,
       s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from n left join n q on n.depth > 0 and q.path = left(n.path, length(n.path) - 32) left join k on k.path = n.path join s on s.path = n.path left join e on e.path = n.path
"""


@query("op13_prefix_trie", OP13)
def op13(t: Tables) -> DataFrame:
    return prefix_trie.prefix_trie(t.conversations)
