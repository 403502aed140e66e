"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from pointmill.llm import quality_rules

CHAT = """
with rows as (
  select conv_id, turn, floor(turn / 256) as block, coalesce(role, 'unknown') as speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start\\|>'), '<|im_end|>', '<|im_end\\|>') as text from conversations
), speakers as (
  select distinct conv_id, speaker as perspective from rows where speaker <> 'system'
), seen as (
  select r.conv_id, s.perspective, r.turn, r.block, r.speaker, r.text, s.perspective is not null and r.speaker = s.perspective as own,
    case when r.speaker = s.perspective then '<|im_start|>assistant' when r.speaker = 'system' then '<|im_start|>system'
         else '<|im_start|>user name=' || replace(replace(translate(r.speaker, chr(13) || chr(10), '  '), '<|im_start|>', '<|im_start\\|>'), '<|im_end|>', '<|im_end\\|>') end || chr(10) as head
  from rows r left join speakers s on r.conv_id is not distinct from s.conv_id
), segments as (
  select *, head || text || '<|im_end|>' || chr(10) as segment from seen
), placed as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective, block order by turn is not null, turn, speaker, segment rows between unbounded preceding and 1 preceding), 0) as place from segments
), pages as (
  select conv_id, perspective, block, count(*)::bigint as n_turns, string_agg(segment, '' order by place) as text,
    coalesce(string_agg(case when own then (place + length(head))::bigint || ':' || (place + length(segment))::bigint end, ',' order by place), '') as masks
  from placed group by all
)
select conv_id, perspective, (row_number() over w - 1)::bigint as page,
  coalesce(sum(length(text)) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start, n_turns, text, masks
from pages window w as (partition by conv_id, perspective order by block nulls first)
"""


def quality_rules_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""
with d as (
  select doc_id, coalesce(text, '') as t, row_number() over () as r from documents
), w as (
  select doc_id, r, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from d
), windows as (
  select r, i, array_to_string(words[i:i + 7], ' ') as g from (select r, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1
), repeated as (
  select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from twice) group by r
), m as (
  select doc_id, len(words)::bigint as n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(repeated.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    length(regexp_replace(t, '[^!]+', '', 'g')) as n_shouts,
    len(list_filter(words, lambda x: lower(x) in ({stops}))) as n_stops
  from w left join repeated using (r)
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, greatest(n_words, 1) as n from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words <= 10000000 and n_symbols / n <= 0.1 and n_shouts / n <= 0.2 and word_chars / n <= 30
    and n_stops / n >= 0.05 and n_dup_lines / greatest(n_lines, 1) <= 0.5 as kept
from b
"""


DECONTAMINATION = """
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w, row_number() over () as r from documents
), bw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null
), items as (
  select item, len(g) as n, array_to_string(g, ' ') as g from (
    select item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) as g from bw where len(w) > 0)
), sizes as (
  select distinct n from items
), windows as (
  select r, p, n, array_to_string(w[p:p + n - 1], ' ') as g from (
    select r, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, sizes where len(w) >= n)
), hits as (
  select r, p, n, item from windows join items using (n, g)
), per_item as (
  select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as said from hits group by r
), per_word as (
  select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from hits)) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(said, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join per_item using (r) left join per_word using (r)
"""


JACCARD = """
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), grams as (
  select distinct r, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), sizes as (
  select r, count(*) as n from grams group by r
), links as (
  select a, b from (select x.r as a, y.r as b, count(*) as m from grams x join grams y on x.g = y.g and x.r <> y.r group by all)
    join sizes s on s.r = a join sizes t on t.r = b where m / (s.n + t.n - m) >= 0.8
), reached as (
  select r as a, r as b from d
  union
  select reached.a, links.b from reached join links on links.a = reached.b
), named as (
  select reached.a as r, min(d.doc_id) as class_id from reached join d on d.r = reached.b group by all
)
select doc_id, class_id, coalesce(n, 0)::bigint as n_links
from d join named using (r) left join (select a as r, count(*) as n from links group by all) using (r)
"""


REPEATS = """
with d as (
  select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as k, encode(coalesce(text, '')) as b, hex(b) as h from documents
), windows as (
  select r, k, p, array_slice(b, p + 1, p + 50) as g from (select r, k, b, unnest(range(0, octet_length(b) - 49)) as p from d)
), first as (
  select g, min(k) as least from windows group by g
), hits as (
  select r, p from windows join first using (g) where least < k
), marked as (
  select r, p, p > 50 + lag(p, 1, -100) over (partition by r order by p) as fresh from hits
), numbered as (
  select r, p, sum(fresh::int) over (partition by r order by p) as span from marked
), spans as (
  select r, min(p) as s, max(p) + 50 as e from numbered group by r, span
), gaps as (
  select r, s, e, lag(e, 1, 0) over (partition by r order by s) as free from spans
), kept as (
  select r, sum(e - s)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * free + 1, 2 * (s - free)), '' order by s) || substr(any_value(h), 2 * max(e) + 1) as t
  from gaps join d using (r) group by r
)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(t, h))) as kept_sha256
from d left join kept using (r)
"""


#: Vectors linked by cosine, all pairs; components by the least id that links reach.
LATTICE_NEIGHBOURS = """
with recursive v as (
  select row_number() over () as r, vec_id, embedding::double[] as x, case when embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0 then sqrt(list_sum(list_transform(embedding::double[], lambda c: c * c))) end as norm from embeddings
), links as (
  select a.r as a, b.r as b, b.vec_id as other from v a join v b on a.r <> b.r and a.norm is not null and b.norm is not null
    and list_dot_product(list_transform(a.x, lambda c: c / a.norm), list_transform(b.x, lambda c: c / b.norm)) >= 0.9
), reach as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), least as (
  select reach.a as r, min(v.vec_id) as least from reach join v on v.r = reach.b group by 1
), counted as (
  select a as r, count(*) as n from links group by 1
)
select vec_id, coalesce(n, 0)::bigint as n_links, case when n is null then vec_id else coalesce(least(vec_id, least), vec_id, least) end as component_id,
  vec_id is not distinct from component_id as kept
from v left join counted using (r) left join least using (r)
"""

#: Exact scores of anchors with all rows: sums of products of whole numbers below 2^53 are exact in double.
HARD_NEGATIVES = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scores as (
  select a.r as ar, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same, coalesce(list_dot_product(a.x, b.x), 0)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.r <> b.r
), positives as (
  select * from (select *, row_number() over (partition by ar order by score desc, vec_id, r) as p from scores where same) where p <= 5
), found as (
  select p.ar, p.p, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.ar, p.p order by s.score desc, s.vec_id, s.r) as rank
  from positives p join scores s on p.ar = s.ar and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": JACCARD, "op10_suffix_dedup": REPEATS, "op1_decontamination": DECONTAMINATION, "op5_chat_perspectives": CHAT, "op7_quality_rules": quality_rules_sql(), "op11_lattice_neighbours": LATTICE_NEIGHBOURS, "op13_hard_negatives": HARD_NEGATIVES}
