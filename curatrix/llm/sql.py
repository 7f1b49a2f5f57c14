"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from curatrix.llm import secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

_DIGITS = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
WARC = f"""
with d as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
 k as (select h, max(page_id) as newest, list_reduce(list_transform(range(8), lambda i: list_transform([('0x' || substr(h, i * 5 + 1, 5))::int], lambda v: {_DIGITS})[1]), lambda a, b: a || b) as digest from d group by 1)
select page_id, payload_bytes, digest as payload_digest, case when page_id = newest then 'response' else 'revisit' end as record_type, case when page_id < newest then newest end as refers_to, true as intact from d join k using (h)"""

_WORDS = f"regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
 p as (select item_id, w, unnest(range(greatest(1, len(w) - 9))) as pos from i where len(w) > 0), q as (select distinct item_id, w[pos + 1: pos + 10] as win from p),
 n as (select distinct len(win) as n from q), s as (select doc_id, n, w[pos + 1: pos + n] as win, pos from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as pos from d, n where len(w) >= n)),
 h as (select doc_id, item_id, pos, n from s join q using (win)), c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as x from h) group by 1),
 e as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct doc_id, item_id::varchar as k from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated from d left join c using (doc_id) left join e using (doc_id)"""


def _spans(rank: int, rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, s, s + length(w[i]) as e from (select doc_id, w, v, i, (coalesce(list_sum(list_transform(g[1: i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1: i - 1], lambda x: length(x))), 0))::bigint as s
 from (select doc_id, w, v, g, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as w, regexp_extract_all(t, '{pattern}', {rule.group}) as v, string_split_regex(t, '{pattern}') as g from d))) where length(v[i]) >= {rule.least}"""


SECRETS = f"""
with d as (select doc_id, coalesce(text, '') as t from documents), s as ({' union all '.join(_spans(n, r) for n, r in enumerate(secret_scan.RULES))}),
 a as (select doc_id, count_if(kind = 'assign') as n_assign, count_if(kind = 'access') as n_access, count_if(kind = 'hex') as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {len(secret_scan.BASE)}) as base from s group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select distinct doc_id, md5(array_to_string(w[pos + 1: pos + 4], ' ')) as h from (select doc_id, w, unnest(range(greatest(1, len(w) - 3))) as pos from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by 1), b as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y using (h) where x.doc_id <> y.doc_id group by 1, 2),
 l as (select a, b from b join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 85 * (na.n + nb.n - common)),
 r as (select a as node, b as to_ from l union select r.node, l.b from r join l on l.a = r.to_)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce((select min(to_) from r where r.node = d.doc_id), d.doc_id)) as component_id from d left join n using (doc_id)"""

JACCARD_LINKS = JACCARD.replace(" as component_id from d", " as component_id, (select count(*) from l where l.a = d.doc_id) as n_links from d")

#: The 256 words of the CRC-32 table, eight halving steps of each byte.
CRC_TABLE = "select list_transform(range(256), lambda b: list_reduce([b::bigint] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as tab"


def crc32(text: str, table: str = "tab") -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, with the table in scope."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {data}, lambda c, b: xor({table}[((xor(c, b) & 255) + 1)::int], c >> 8)), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, leaves: str, levels: int = 9) -> str:
    """CTEs ``{name}steps(g, k, i, b, a)`` and ``{name}top(g, h)`` of ``leaves(g, i, h, n)``: ``levels`` rounds of hashing runs of eight, enough for 8 ** levels leaves."""
    made = [f"{name}0 as (select g, i, h, n from {leaves})"]
    for k in range(levels):
        made.append(f"{name}{k + 1} as (select g, i // 8 as i, case when any_value(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h, any_value((n + 7) // 8) as n from {name}{k} group by g, i // 8)")
    steps = " union all ".join(
        f"select x.g, {k} as k, x.i, coalesce(string_agg(y.h, '' order by y.i) filter (y.i < x.i), '') as b, coalesce(string_agg(y.h, '' order by y.i) filter (y.i > x.i), '') as a from {name}{k} x join {name}{k} y on x.g = y.g and x.i // 8 = y.i // 8 where x.n > 1 group by x.g, x.i" for k in range(levels))
    return ", ".join([*made, f"{name}steps as ({steps})", f"{name}top as (select g, h from {name}{levels})"])


_LOW_TEXT = f"translate(text, '{_UPPER}', '{_LOWER}')"
MERKLE = f"""
with c as materialized ({CRC_TABLE}),
 d as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n, row_number() over () as rid from
  (select doc_id, coalesce('1' || lang, '0') as g, {_leaf('text')} as leaf, case when {crc32('doc_id::varchar')} % 3 = 0 then {_leaf(_LOW_TEXT)} else {_leaf('text')} end as tampered from documents, c)),
 {_tree('t', '(select g, i, leaf as h, n from d)')},
 s as (select g as lang, '' as g, row_number() over (order by encode(g)) - 1 as i, h, count(*) over () as n from ttop), {_tree('u', 's', 6)},
 p as (select d.rid, t.k as k, t.b, t.a from d join tsteps t on t.g = d.g and t.i = d.i // (8 ** t.k)::bigint union all
  select d.rid, 100 + u.k, u.b, u.a from d join s on s.lang = d.g join usteps u on u.i = s.i // (8 ** u.k)::bigint),
 q as (select rid, list({{'b': b, 'a': a}} order by k) as steps from p group by rid),
 f as (select d.*, coalesce(steps, []) as steps, s.h as subroot, u.h as root from d join s on s.lang = d.g left join q using (rid), utop u),
 r as (select doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_transform(steps, lambda x: x.b || x.a), lambda x, y: x || y, ''), '')) as proof_sha256,
  list_reduce([{{'b': tampered, 'a': ''}}] || steps, lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b as folded_root from f)
select *, folded_root = root as verified from r"""

_RUNS = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+'))"
SPELLING = f"""
with recursive c as materialized ({CRC_TABLE}), r as (select doc_id, run, count(*) as n from (select doc_id, {_RUNS} as run from documents) group by 1, 2),
 h as (select run, n, {crc32("doc_id::varchar || ':' || run")} as h from r, c),
 w as materialized (select word, sum(n)::bigint as n from (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h) where length(word) >= 5 group by 1 having sum(n) >= 3),
 d as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from (select word, n, unnest(range(length(word))) as i from w)),
 p as (select x.word, y.word as other, y.n as other_n from d x join d y on x.i = y.i and x.less = y.less and x.word <> y.word
  union select d.word, w.word, w.n from d join w on w.word = d.less union select w.word, d.word, d.n from d join w on w.word = d.less),
 b as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as best, max(other_n) as best_n from p group by 1),
 f as materialized (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from w left join b using (word)),
 t as (select word, word as root from f union all select t.word, f.form from t join f on f.word = t.root where f.form is not null)
select f.word, f.form, z.root, f.n, f.n_near, f.form_n from f join (select t.word, t.root from t join f on f.word = t.root where f.form is null) z using (word)"""

EMBEDDINGS = """
with recursive e as (select vec_id, list_transform(embedding, lambda x: x::double) as v, embedding is not null and len(embedding) > 0 and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false) and list_max(list_transform(embedding, lambda x: abs(x))) > 0 as ok from embeddings),
 u as materialized (select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from e where ok),
 l as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.u) = len(b.u) where list_dot_product(a.u, b.u) >= 0.95),
 r as (select a as node, b as to_ from l union select r.node, l.b from r join l on l.a = r.to_),
 g as (select node, min(to_) as least from r group by 1), n as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(g.least, vec_id)) as component_id, vec_id <= coalesce(g.least, vec_id) as kept from e left join g on g.node = vec_id left join n on n.a = vec_id"""
