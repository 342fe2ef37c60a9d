"""DuckDB SQL for the results of queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BENCH = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR = f"""
with recursive d as (select doc_id, {_WORDS.format(t=_ASCII)} w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s from d),
e as (select doc_id, len(s) n, unnest(s) x from s),
l as (select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
u as (select a, b from l union select b, a from l), r(a, b) as (select a, b from u union select r.a, u.b from r join u on r.b = u.a)
select s.doc_id, cast(len(s) as bigint) n_shingles, least(s.doc_id, coalesce(m.m, s.doc_id)) component_id, s.doc_id = least(s.doc_id, coalesce(m.m, s.doc_id)) kept
from s left join (select a, min(b) m from r group by a) m on m.a = s.doc_id
"""

LINES = """
with d as (select doc_id, string_split(text, chr(10)) x from documents),
l as (select doc_id, x, list_transform(x, lambda y: rtrim(y, ' ')) t from d),
w as (select doc_id, i, t[i:i+2] k from l, unnest(range(1, len(x) - 1)) u(i) where trim(array_to_string(t[i:i+2], ''), ' ') <> ''),
f as (select *, row_number() over (partition by k order by doc_id, i) = 1 as first from w),
g as (select distinct doc_id, unnest(range(i, i + 3)) p from f where not first),
e as (select doc_id, unnest(range(1, len(x) + 1)) p, unnest(x) y from d),
r as (select e.doc_id, count(g.p) n_removed, string_agg(case when g.p is null then y end, chr(10) order by e.p) kept from e left join g using (doc_id, p) group by 1)
select d.doc_id, cast(len(x) as bigint) n_lines, n_removed, sha256(coalesce(kept, '')) kept_sha256 from d join r using (doc_id)
"""

SUBSTRINGS = f"""
with d as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} w from documents),
win as (select doc_id, i, array_to_string(w[i:i+12], ' ') k from d, unnest(range(1, len(w) - 11)) t(i)),
f as (select k, min(doc_id) m from win group by 1),
hit as (select distinct doc_id, unnest(range(i, i + 13)) p from win join f using (k) where m < doc_id),
wd as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from d),
r as (select wd.doc_id, count(hit.p) h, string_agg(case when hit.p is null then x end, ' ' order by wd.p) kept from wd left join hit using (doc_id, p) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(h, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join r using (doc_id)
"""

_BITS = rf"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS.format(t="coalesce(text, '')")} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
win as (select doc_id, i, array_to_string(w[i:i+7], ' ') k from d, unnest(range(1, len(w) - 6)) u(i)),
two as (select *, count(*) over (partition by doc_id, k) c from win),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from two where c > 1) group by 1),
m as (select d.doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
 len(l) n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) n_upper, len(regexp_extract_all(t, '!')) n_exclaims, len(list_filter(l, lambda x: rtrim(x, ' ') like '%...' or rtrim(x, ' ') like '%…')) n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣]\s'))) n_bullet, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i+1])) n_stutters
 from d left join rep using (doc_id)),
b as (select *, (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end) + (case when 100 * n_symbols > 10 * n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
 + (case when 100 * n_upper > 40 * word_chars then 16 else 0 end) + (case when 100 * n_exclaims > 25 * n_words then 32 else 0 end) + (case when word_chars < 2 * n_words then 64 else 0 end) + (case when word_chars > 15 * n_words then 128 else 0 end)
 + (case when 100 * n_ellipsis > 30 * n_lines then 256 else 0 end) + (case when 100 * n_bullet > 90 * n_lines then 512 else 0 end) + (case when 100 * n_stutters > 20 * n_words then 1024 else 0 end) bits from m)
"""

QUALITY = f"""{_BITS.strip()}
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, bits & 3 <> 0 base_failed, bits = 0 kept, cast(bits as bigint) failed_bits from b
"""

#: Rules in the order of their bits.
_RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "exclamations", "short_words", "long_words", "ellipses", "bullets", "stutters")
ABLATION = f"{_BITS.strip()}\n" + "\nunion all ".join(
    f"select '{r}' as rule, count(*) filter (bits & {1 << k} <> 0) n_failed, count(*) filter (bits = {1 << k}) n_failed_alone, count(*) filter (bits & {2047 & ~(1 << k)} = 0) n_kept_without from b" for k, r in enumerate(_RULES)
)

LEAKS = f"""
with d as (select doc_id, {_BENCH.format(t=_ASCII)} w from documents), b as (select cast(item_id as varchar) item, {_BENCH.format(t=_ASCII)} w from benchmark),
k as (select distinct item, least(len(w), 10) m, array_to_string(w[i:i+9], ' ') k from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
win as (select doc_id, m, i, array_to_string(w[i:i+m-1], ' ') k from d, (select distinct m from k) s, unnest(range(1, len(w) - m + 2)) t(i)),
hit as (select win.doc_id, win.i, win.m, k.item from win join k using (m, k)),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from hit) group by 1),
t as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hit group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join n using (doc_id) left join t using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": NEAR.strip(),
    "op2_line_dedup": LINES.strip(),
    "op7_substring_dedup": SUBSTRINGS.strip(),
    "op8_quality_rules": QUALITY.strip(),
    "op9_benchmark_decontamination": LEAKS.strip(),
    "quality_ablation": ABLATION,
}
