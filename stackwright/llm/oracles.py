"""DuckDB SQL for the registered queries that SQL can express."""

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _key(u: str) -> str:
    host, path, query = (f"regexp_extract({u}, '{_URL}', {i})" for i in (1, 2, 3))
    return f"case when {host} <> '' then {_LOW.format(host)} || case when {path} = '' then '/' else {path} end || {query} end"


def _rule(host: str, path: str, what: int) -> str:
    """The longest rule that fits, or its verdict (what: 0 the verdict, 1 the rule)."""
    rules = [("allow", "example.net/en/", "example.net", "/en/"), ("block", "example.com/de/", "example.com", "/de/"), ("allow", "org/fr/", "org", "/fr/"), ("block", "net/", "net", "/")]
    return "case " + " ".join(f"when ({host} = '{h}' or suffix({host}, '.{h}')) and starts_with({path}, '{p}') then '{(v, r)[what]}'" for v, r, h, p in rules) + " end"


def _alike(k: int, percent: int, more: str) -> str:
    """Components of documents by their k-word shingles; candidates share one of the rarest, as sets of that similarity must; then full sets."""
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) < {k} then case when len(w) > 0 then [array_to_string(w, ' ')] else [] end else list_transform(range({k}, len(w) + 1), lambda i: array_to_string(w[i - {k - 1}:i], ' ')) end) s from w),
x as (select doc_id, len(s) n, unnest(s) g from s), f as (select g, count(*) c from x group by g),
r as (select x.doc_id, n, x.g, row_number() over (partition by x.doc_id order by c, x.g) k from x join f on x.g = f.g),
p as (select * from r where k <= n - ceil(n * {percent} / 100) + 1),
c as (select distinct a.doc_id a, b.doc_id b from p a join p b on a.g = b.g and a.doc_id < b.doc_id where 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
i as (select a, b, len(x.s) + len(y.s) n, len(list_intersect(x.s, y.s)) i from c join s x on x.doc_id = a join s y on y.doc_id = b),
e as (select a u, b v from i where 100 * i >= {percent} * (n - i) union all select b, a from i where 100 * i >= {percent} * (n - i)),
t(u, v) as (select doc_id, doc_id from s union select t.u, e.v from t join e on t.v = e.u),
m as (select u, min(v) c from t group by u)
select doc_id, len(s)::bigint as n_shingles, c as component_id{more} from s join m on u = doc_id"""


_TERMS = rf"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _repair() -> str:
    """Conversations by a fold over their rows: the least (cost, audit) in each state, nothing read (z), after s, u or a."""
    cheap = lambda *x: "case " + " ".join(f"when {a} is not null and " + " and ".join(f"({b} is null or {a} <= {b})" for b in x if b != a) + f" then {a}" for a in x) + " end"
    plus = lambda x, n, c: f"case when {x} is not null then {{'c': {x}.c + {n}, 't': {x}.t || '{c}'}} end"
    ins = "{'z': p.z, 's': p.s, 'u': %s, 'a': p.a}" % cheap("p.u", f"({plus('p.z', 3, 'I')})", f"({plus('p.s', 3, 'I')})", f"({plus('p.a', 3, 'I')})")
    ins2 = "{'z': q.z, 's': q.s, 'u': q.u, 'a': %s}" % cheap("q.a", f"({plus('q.u', 3, 'I')})")
    one = lambda x, to, i: f"(case when {x} is not null and not r.go then case when r.i = '{i}' then {{'c': {x}.c + r.x, 't': {x}.t || 'K'}} else {{'c': {x}.c + 3 + r.x, 't': {x}.t || 'R'}} end end)"
    keep = f"(case when not r.go and r.i = 's' and q.z is not null then {{'c': q.z.c + r.x, 't': q.z.t || 'K'}} end)"
    d = lambda x: f"({plus(x, 4, 'D')})"
    step = "{'z': %s, 's': %s, 'u': %s, 'a': %s}" % (d("q.z"), cheap(d("q.s"), keep), cheap(d("q.u"), one("q.z", "u", "u"), one("q.s", "u", "u"), one("q.a", "u", "u")), cheap(d("q.a"), one("q.u", "a", "a")))
    ws = r"[^\x20\x09-\x0D]"
    return rf"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') role0, coalesce(text, ' ') text0, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
crc as (select k, (xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda c, x: list_reduce([xor(c, x)] || range(8), lambda a, j: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)), 4294967295) % 20)::int h from (select distinct k from k)),
d as (select conv_id, turn, case when h = 4 then 'user' else role0 end r, case h when 1 then '' when 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end t, unnest(range(case h when 0 then 0 when 3 then 2 else 1 end)) cp from k join crc using (k)),
o as (select *, row_number() over w n, row_number() over (partition by conv_id, r, t order by turn nulls first, cp) again, lag(r[1]) over w before from d window w as (partition by conv_id order by turn nulls first, r, md5(t), cp)),
f as (select *, case when not regexp_matches(t, '{ws}') then 'b' when again > 1 then 'd' when not regexp_matches(t, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end f from o),
g as (select conv_id, count(distinct turn) turns, max(turn) hi, min(turn) lo, count(*) filter (f = 'b') blank, count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated,
    count(*) filter (n > 1 and before || r[1] not in ('su', 'ua', 'au')) illegal, list({{'r': r, 't': t}} order by n) rows, list({{'i': r[1], 'go': f in ('b', 'd'), 'x': case when f = 't' then 3 else 0 end}} order by n) rs from f group by conv_id),
w(conv_id, rs, rows, i, p) as (select conv_id, rs, rows, 0, {{'z': {{'c': 0, 't': ''}}, 's': null::struct(c int, t varchar), 'u': null::struct(c int, t varchar), 'a': null::struct(c int, t varchar)}} from g union all
  select conv_id, rs, rows, i + 1, {step} from (select conv_id, rs, rows, i, rs[i + 1] r, {ins2} q from (select conv_id, rs, rows, i, {ins} q from w p(conv_id, rs, rows, i, p) where i < len(rs)))),
e as (select conv_id, rows, {ins2} q from (select conv_id, rows, {ins} q from w p(conv_id, rs, rows, i, p) where i = len(rs))),
b as (select conv_id, rows, {cheap("q.z", "q.a")} x from e),
l as (select conv_id, rows, x, generate_subscripts(string_split_regex(x.t, ''), 1) j from b where x.t <> ''),
m as (select conv_id, j, x.t[j] l, rows[len(replace(x.t[:j], 'I', ''))] r, len(replace(x.t[:j], 'D', '')) place from l),
s as (select conv_id, max(case when place = 1 and l = 'K' and r.r[1] = 's' then 1 else 0 end) has from m group by conv_id),
y as (select conv_id, string_agg(case when l = 'K' then r.r else case when (place - has) % 2 = 1 then 'user' else 'assistant' end end || ':' || case when l = 'I' then '' else r.t end, chr(10) order by j) y from m join s using (conv_id) where l <> 'D' group by conv_id)
select c.conv_id, coalesce(hi - lo + 1 - turns, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
  coalesce(x.c, 0)::bigint as cost, coalesce(x.t, '') audit, sha256(coalesce(y, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join g using (conv_id) left join b using (conv_id) left join y using (conv_id)"""


SQL = {
    "op11_lexical_topk": rf"""
with x as (select row_number() over () r, doc_id, {_TERMS} w from documents),
g as (select count(*) docs, sum(len(w))::bigint words from x where len(w) > 0),
t as (select r, doc_id, n, u, count(*) tf from (select r, doc_id, len(w) n, unnest(w) u from x) group by all),
f as (select u, count(*) df from t group by u),
i as (select q, item_id, unnest(list_distinct(w)) u from (select row_number() over () q, item_id, {_TERMS} w from benchmark)),
s as (select q, item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::bigint score from i join t using (u) join f using (u), g group by all)
select item_id, (row_number() over (partition by q order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0 qualify rank <= 10""",
    "op12_conversation_repair": _repair(),
    "op5_warc_index": r"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h)) n, from_hex(sha1(h))::bit::varchar b from p),
e as (select page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(b, 5 * i + 1, 5)::bit::integer, 1)), '') s from d)
select page_id, n::bigint as payload_bytes, s as payload_digest, case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to
from (select *, max(page_id) over (partition by s) m from e)""",
    "op7_minhash_dedup": _alike(2, 80, ", doc_id = c as kept"),
    "op13_jaccard_join": _alike(3, 90, ""),
    "op9_url_filter": rf"""
with recursive p as (
  select page_id, coalesce({_LOW.format(f"regexp_extract(url, '{_URL}', 1)")}, '') host, coalesce(regexp_extract(url, '{_URL}', 2), '') path, {_key('url')} k,
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) c, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) r from pages),
l as (select k, regexp_extract(c, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) h from p where c <> '' union all select k, regexp_extract(r, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) from p where r <> ''),
f as (select k, replace(h, '&amp;', '&') h, regexp_extract(k, '(?s)^([^/?]*)', 1) host, regexp_extract(k, '(?s)^[^/?]*([^?]*)', 1) path from l where k is not null and h <> ''),
t as (select k, case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*://') then h when starts_with(h, '//') then 'x:' || h when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') then null
    when starts_with(h, '/') then 'x://' || host || h when regexp_matches(h, '^[?#]') then 'x://' || host || path || h else 'x://' || host || regexp_replace(path, '[^/]*$', '') || h end u from f),
e as (select k u, {_key('u')} v from t where {_key('u')} is not null),
b as (select u, v from e union select v, u from e),
reach(u, v) as (select u, u from b union select reach.u, b.v from reach join b on reach.v = b.u),
j as (select distinct u, v, {_rule("regexp_extract(v, '(?s)^([^/?]*)', 1)", "regexp_extract(v, '(?s)^[^/?]*([^?]*)', 1)", 0)} verdict from reach),
g as (select u from j group by u having bool_or(verdict = 'block') and not coalesce(bool_or(verdict = 'allow'), false))
select page_id, host, path, {_rule('host', 'path', 1)} as rule, coalesce({_rule('host', 'path', 0)}, case when k in (select u from g) then 'block' else 'allow' end) as verdict from p""",
    "op10_quality_rules": r"""
with w as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
x as (select row_number() over () r, * from w),
g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select r, w, unnest(range(1, len(w) - 1)) i from x)),
d as (select r, i from (select r, i, count(*) over (partition by r, g) n from g) where n > 1),
c as (select r, count(distinct i + o) n from d, (values (0), (1), (2)) v(o) group by r),
b as (select x.r, doc_id, source, len(w) n_words, length(array_to_string(w, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) n_dup_lines,
    coalesce(c.n, 0) n_repeat_words from x left join c on x.r = c.r),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from b),
h as (select source, count(*) n, count(*) filter (base_failed) k from f group by source),
p as (select count(*) c, sum(n)::double n, sum(k)::double k, sum(k::double * k / n) q, sum(n::double * n) w from h),
m as (select k / n m, (k / n) * (1 - k / n) noise, n - w / n - (c - 1) known, q - k * k / n spread, c from p),
r as (select m, case when noise > 0 and known > 0 then (spread / noise - (c - 1)) / known else 0 end r from m),
s as (select m, case when r > 0 then least(greatest(1 / r - 1, 1), 10000) else 10000 end s from r),
z as (select source, (k + m * s) / (n + s) > 0.5 bad from h, s)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed, not base_failed and not bad as kept
from f join z on f.source is not distinct from z.source""",
}
