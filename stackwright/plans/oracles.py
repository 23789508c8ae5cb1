"""DuckDB SQL for the registered queries of the document operators."""

from __future__ import annotations

from stackwright.functions import lexicon
from stackwright.operators.understanding import normalize_synonyms
from stackwright.plans.fixtures import HAN, KB, QUESTION

WS = r"[\t-\r\x1c-\x20]"
KBT = "kb as (select doc_id, text, " + ", ".join(f"{e} as {c}" for c, e in KB.items()) + " from documents)"
OWN = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
CH = (
    f"{KBT}, own as (select *, {OWN} l from kb), "
    "ch as (select *, unnest(l) content, unnest(range(len(l))) i from own), "
    "chunks as (select sha256(source || ':' || i) id, source, i::int chunk_index, content, sha256(content) content_hash, doc_type, version, department, model_type, product_line, doc_id from ch)"
)
MD = f"{KBT}, md as (select source, doc_id, array_to_string(list_transform({OWN}, lambda x, i: case i % 6 when 1 then '# ' || x when 3 then '- ' || x when 4 then '| ' || x || ' |' else x end), chr(10) || chr(10)) text from kb)"
Q = f"q as (select item_id query_id, text passage, {QUESTION} question from benchmark)"
TOK = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"
BM25 = f"""{CH}, tok as (select id, source, content, {TOK.format('content')} t from chunks), tl as (select id, len(t) dl from tok where len(t) > 0),
post as (select id, term, count(*) tf from (select id, unnest(t) term from tok) group by all), st as (select count(*) n, avg(dl) avgdl from tl),
df as (select term, count(*) df from post group by term), idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) raw from df, st), me as (select avg(raw) m from idf),
ask as (select item_id query_id, term, count(*) times from (select item_id, unnest({TOK.format('text')}) term from benchmark) group by all),
sc as (select query_id, id, sum(times * case when raw < 0 then 0.25 * m else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) bm25 from ask join idf using (term) join post using (term) join tl using (id), st, me group by all),
rk as (select query_id, id, bm25, row_number() over (partition by query_id order by round(bm25, 9) desc, id) as rank from sc),
hits as (select query_id, rk.id, rank, bm25, source, content from rk join chunks on rk.id = chunks.id where rank <= 20)"""
CAP = """cap as (select * from (select *, row_number() over (partition by query_id, source order by rank) n from hits) where n <= {n}), top as (select query_id, id, source, bm25, content, row_number() over (partition by query_id order by rank) as rank from cap)"""
STATE = "so as (select source, sha256(text) h, doc_id * 1000 m from kb where doc_id % 11 <> 0), sn as (select source, case when doc_id % 5 = 0 then reverse(sha256(text)) else sha256(text) end h, doc_id * 1000 m from kb where doc_id % 13 <> 0), dif as (select coalesce(so.source, sn.source) source, case when so.source is null then 'added' when sn.source is null then 'deleted' when so.h = sn.h and so.m = sn.m then 'unchanged' else 'changed' end change from so full join sn on so.source = sn.source)"
NEW = f"{CH}, nd as (select doc_id, source, case when doc_id % 5 = 0 then replace(text, 'e', 'E') else text end text from kb where doc_id % 13 <> 0), nl as (select source, unnest({OWN}) content, unnest(range(len({OWN}))) i from nd), nc as (select sha256(source || ':' || i) id, source, sha256(content) content_hash from nl), oc as (select id, source, content_hash from chunks where doc_id % 11 <> 0), {STATE}"
PARA = f"{KBT}, pl as (select source, string_split(text, chr(10)) l from kb), pr as (select source, unnest(l) t, unnest(range(len(l))) pos from pl), para as (select source, pos, pos % 5 = 0 head, case when pos % 5 = 3 then '' else trim(t, chr(9) || chr(10) || ' ') end text from pr)"
SIDE = "side as (select *, case when doc_id % 7 = 0 then '{' else null end bad from kb where doc_type <> '')"
FAULT = """case doc_id % 9 when 0 then chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'API response' || chr(10) when 1 then chr(10) || '#bad' || chr(10) || '#  ' || chr(10) || '# a' || chr(10) || '# b' || chr(10)
 when 2 then chr(10) || '```' || chr(10) || '# code' || chr(10) || 'API' || chr(10) || '```' || chr(10) || '注意: x' || chr(10) when 3 then chr(10) || '1. a' || chr(10) || '2. b' || chr(10) || '4. c' || chr(10) || chr(10) || '7. d' || chr(10)
 when 4 then chr(10) || '中文abc 和 １２ 34' || chr(10) when 5 then chr(10) || 'same line here' || chr(10) || 'same line here' || chr(10) when 6 then chr(10) || '[a](missing.md) [b](../dir1/none.md#x) [c](http://x.y)' || chr(10)
 when 7 then chr(10) || '进行进行 的的' || chr(10) else chr(10) || 'assertion timeout' || chr(10) end"""
LINES = f"""{MD}, cd as (select source file_path, text || {FAULT} text from md), sp as (select file_path, string_split(text, chr(10)) l from cd),
ln as (select file_path, unnest(l[:len(l) - 1]) line, unnest(range(1, len(l))) lineno from sp),
st0 as (select *, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') stripped from ln), fe as (select *, regexp_matches(stripped, '^(?:`{{3,}}|~{{3,}})') fence from st0),
lines as (select *, fence or (sum(fence::int) over (partition by file_path order by lineno)) % 2 = 1 in_code, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\[([^\\]]+)\\]\\([^\\)]*\\)', '\\1', 'g'), '^#{{1,6}}\\s+', ''), '^[-*+]\\s+', ''), '^\\d+\\.\\s+', '') plain from fe)"""


def _issue(body: str, line: str, col: str, level: str, category: str, message: str, context: str, suggestion: str = "''") -> str:
    return f"with {LINES} select file_path, ({line})::int as line, ({col})::int as col, '{level}' as level, '{category}' as category, {message} as message, {context} as context, {suggestion} as suggestion from {body}"


RT = f"regexp_replace(line, '{WS}+$', '')"
SQL: dict[str, str] = {
    "passage_sources": f"with {BM25}, {CAP.format(n=5)} select query_id, rank, source, round(bm25, 4) as bm25 from top where rank <= 5",
    "bm25_corpus": f"with {BM25} select query_id, id, rank, round(bm25, 4) as bm25 from rk where rank <= 10",
    "dedupe_sources": f"with {BM25}, {CAP.format(n=1)} select query_id, rank, id, source from top where rank <= 5",
    "top_sources": f"with {BM25}, f as (select query_id, source, min(rank) r from hits where rank <= 5 group by all) select query_id, list(source order by r) as sources from f group by query_id",
    "retrieve_text": f"with {BM25} select query_id, md5(string_agg(content, chr(10) order by rank)) as contents from hits group by query_id",
    "candidate_pool": f"with {BM25} select query_id, id, rank as vector_rank from hits",
    "assemble_context": f"with {BM25}, {CAP.format(n=5)} select query_id, md5(string_agg('[来源: ' || top.source || ' | 版本: ' || version || ' | 部门: ' || department || ']' || chr(10) || top.content, chr(10) order by rank)) as context from top join chunks on top.id = chunks.id where rank <= 5 group by query_id",
    "bm25_rank": f"""with {BM25}, p as (select query_id, id, content, row_number() over (partition by query_id order by id) vr, {TOK.format('content')} t from hits), w as (select query_id, count(*) n, avg(len(t)) avgdl from p group by all),
tm as (select query_id, id, len(t) dl, unnest(t) term from p), tf as (select query_id, id, dl, term, count(*) tf from tm group by all), d as (select query_id, term, count(*) df from tf group by all),
r as (select d.query_id, term, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) raw from d join w using (query_id)), m as (select query_id, avg(raw) m from r group by all),
s as (select tf.query_id, id, sum(times * case when raw < 0 then 0.25 * m.m else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) b from tf join r on tf.query_id = r.query_id and tf.term = r.term join m on m.query_id = tf.query_id join ask on ask.query_id = tf.query_id and ask.term = tf.term group by all)
select p.query_id, p.id, row_number() over (partition by p.query_id order by round(coalesce(b, 0), 9) desc, vr) as bm25_rank, round(coalesce(b, 0), 4) as bm25 from p left join s on p.query_id = s.query_id and p.id = s.id""",
    "doc_state": f"""with {KBT}, {SIDE}, f as (select source, sha256(text) h, doc_id from kb) select source, h as file_hash, meta_hash, m::bigint as mtime_s from
(select source, h, coalesce((select sha256(case when doc_id % 7 = 0 then '{{' else '{{"doc_type":"' || doc_type || '","version":"' || substr(version, 2) || '","department":"' || department || '","classification":"secret"}}' end) from side where side.source = f.source), '') meta_hash, doc_id m from f
union all select source || '.meta.json', sha256(case when doc_id % 7 = 0 then '{{' else '{{"doc_type":"' || doc_type || '","version":"' || substr(version, 2) || '","department":"' || department || '","classification":"secret"}}' end), '', doc_id from side)""",
    "load_metadata": f"with {KBT} select source, case when doc_type <> '' and doc_id % 7 <> 0 then doc_type else '' end as doc_type, case when doc_type <> '' and doc_id % 7 <> 0 then version else '' end as version, case when doc_type <> '' and doc_id % 7 <> 0 then department else '' end as department, case when doc_type <> '' and doc_id % 7 <> 0 then 'secret' else '公开' end as confidentiality, '已发布' as status from kb",
    "fill_metadata": f"with {KBT} select source, product_line, 'x' as owner, '已发布' as status, case when doc_type <> '' and doc_id % 7 <> 0 then version else '' end as version from kb",
    "extract_xml_metadata": f"with {KBT} select source, product_line, version, department as owner from kb",
    "normalize_version": f"with {KBT} select source, case doc_id % 3 when 2 then '' else version end as version from kb",
    "parse_track": f"with {KBT} select case when suffix(source, '.log') then 'log' else 'structured_doc' end as track, split_part(source, '.', 2) as format, count(*) as n from kb group by all",
    "chunk_records": f"with {CH} select id, source, chunk_index, content_hash, case when suffix(source, '.log') then 'log' else 'structured_doc' end as parse_track, split_part(source, '.', 2) as file_format, doc_type, '公开' as confidentiality from chunks",
    "chunk_paragraphs": f"with {MD}, s as (select source, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') l from md) select source, unnest(range(len(l)))::int as chunk_index, unnest(l) as content from s",
    "chunk_log": f"with {KBT}, o as (select source, {OWN} l from kb), b as (select source, l, unnest(range((len(l) + 29) // 30)) i from o) select source, i::int as chunk_index, array_to_string(l[30 * i + 1:30 * i + 30], chr(10)) as content from b",
    "chunk_window_split": f"with {MD}, p as (select source, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') l from md), w as (select source, case when length(text) <= 800 or len(l) <= 4 then [text] else list_transform(range(0, len(l), 2), lambda i: array_to_string(l[i + 1:i + 4], chr(10) || chr(10))) end c from p) select source, unnest(range(len(c)))::int as pos, unnest(c) as content from w",
    "chunk_rows": "with p as (select 'parts-' || (p_partkey % 10) || '.csv' source, p_partkey k, 'p_name: ' || p_name || case when p_size > 25 then ' | p_size: ' || p_size else '' end c from part), a as (select source, k, c from p union all select distinct source, null, '字段: p_name | p_size' from p) select source, (row_number() over (partition by source order by k nulls first) - 1)::int as chunk_index, c as content from a",
    "chunk_runs": f"""with {PARA}, s as (select *, head and text <> '' h from para), k as (select *, h or text = '' or coalesce(lag(h) over (partition by source order by pos), false) stop from s), r as (select *, sum(stop::int) over (partition by source order by pos) run from k),
g as (select source, run, min(pos) pos, string_agg(text, ' ' order by pos) content from r where text <> '' group by source, run) select source, (row_number() over (partition by source order by pos) - 1)::int as chunk_index, content from g""",
    "chunk_slides": f"with {PARA}, g as (select source, pos // 4 + 1 n, string_agg(text, ' ' order by pos) t from para where text <> '' group by all) select source, (row_number() over (partition by source order by n) - 1)::int as chunk_index, '[幻灯片 ' || n || '] ' || t as content from g",
    "diff_states": f"with {KBT}, {STATE} select source, change from dif",
    "diff_chunks": f"with {NEW} select nc.id, nc.source, case when oc.id is null then 'add' when oc.content_hash = nc.content_hash then 'skip' else 'update' end as action from nc left join oc on nc.id = oc.id",
    "chunks_by_source": f"with {CH} select source, list(id order by id) as ids from chunks group by source",
    "delete_by_sources": f"with {CH}, {STATE}, g as (select source from dif where change in ('changed', 'deleted')) select 'kept' as what, count(*) as n from chunks where source not in (select source from g) union all select 'deleted', count(*) from chunks where source in (select source from g)",
    "sync_incremental": f"with {NEW} select id, content_hash from oc where source not in (select source from dif where change in ('changed', 'deleted')) union all select id, content_hash from nc where source in (select source from dif where change in ('added', 'changed'))",
    "upsert_chunks": f"with {NEW} select id, content_hash from oc where id not in (select id from nc) union all select id, content_hash from nc",
    "sync_summary": f"with {NEW}, a as (select case when oc.id is null then 'add' when oc.content_hash = nc.content_hash then 'skip' else 'update' end a from nc left join oc on nc.id = oc.id) select " + ", ".join(f"(select count(*) from dif where change = '{c}') as files_{c}" for c in ("added", "changed", "deleted", "unchanged")) + ", count(*) as total, count(*) filter (a = 'add') as added, count(*) filter (a = 'update') as updated, count(*) filter (a = 'skip') as skipped from a",
    "ingest_summary": f"with {CH} select source, count(*) as n_chunks from chunks group by rollup (source)",
    "tokenize": f"with {KBT}, t as (select source, unnest({TOK.format('text')}) token from kb) select token, count(*) as n, count(distinct source) as docs from t group by token",
    "exact_terms": f"""with {Q}, f as (select query_id, question, regexp_extract_all(question, '(?i)\\b(?:QE|8D)-\\d{{4}}-\\d{{4}}\\b') || regexp_extract_all(question, '(?i)\\b[A-Z]{{2,6}}-\\d{{3,5}}\\b') || regexp_extract_all(question, '(?i)\\bV\\d+(?:\\.\\d+){{1,2}}\\b') l from q)
select query_id, l as rerank_terms, regexp_extract_all(question, '(?i)\\b[A-Z]{{2,6}}-\\d{{3,5}}\\b') as models, contains(question, 'WPS-3100') as has_3100 from f""",
    "extract_entities": f"""with {Q} select query_id, case when query_id % 8 = 5 then ['WPS-' || (3000 + 100 * (query_id % 4)), 'SCT-200'] else ['WPS-' || (3000 + 100 * (query_id % 4))] end as model_types, ['V' || (1 + query_id % 3) || '.' || (query_id % 4)] as versions,
case when query_id % 8 = 1 then ['VIS-' || (1000 + query_id)] else [''][1:0] end as fault_codes, case when query_id % 8 = 2 then ['QE-2025-' || (1000 + query_id)] else [''][1:0] end as doc_ids from q""",
    "vector_topk": "with v as (select vec_id, embedding::double[] e from embeddings), d as (select a.vec_id query_id, b.vec_id id, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e) distance from v a, v b where a.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from d) select query_id, id, rank, round(distance, 6) as distance, round(1 - distance, 4) as score from r where rank <= 10",
    "vector_topk_filtered": "with v as (select vec_id, embedding::double[] e, label from embeddings), d as (select a.vec_id query_id, b.vec_id id, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e) distance from v a, v b where a.vec_id % 100 = 0 and (a.vec_id % 200 <> 0 or b.label = 3)), r as (select *, row_number() over (partition by query_id order by round(distance, 12), id) as rank from d) select query_id, id, rank from r where rank <= 10",
    "meta_options": f"with {KBT} select distinct 'product_line' as field, product_line as value from kb union all select distinct 'version', version from kb",
    "knowledge_gaps": "with a as (select strftime(ts, '%Y-%m-%dT%H:%M:%S') ts, event_type || ' ' || user_id || ' ' || event_id question, value / 1000 s from events), g as (select * from a where s < 0.1) select ts, question, s as max_rerank_score, (select count(*) from g) as total from g order by ts desc, question limit 50",
    "corpus_by_dir": f"with {KBT} select split_part(source, '/', 1) as top, '' as sub, count(*) as n from kb group by all",
    "files_by_dir": f"with {KBT} select split_part(source, '/', 1) as top, '' as sub, split_part(source, '/', 2) as name from kb",
    "meta_coverage": f"with {KBT} select count(*) as total, count(*) filter (doc_type <> 'test_case') as covered, count(*) filter (doc_type = 'test_case') as missing from kb",
    "missing_sidecars": f"with {KBT} select source from kb where doc_type = 'test_case'",
    "doc_type_distribution": f"with {KBT} select case when doc_type = '' then 'unknown' else doc_type end as doc_type, count(*) as n from kb where doc_type <> 'test_case' group by all",
    "code_block_flag": f"with {LINES} select file_path, lineno::int as lineno, in_code from lines",
    "check_heading_format": f"with {LINES} select * from (select file_path, lineno::int as line, 1 as col, 'error' as level, '格式规范' as category, '标题 # 号后缺少空格' as message, substr({RT}, 1, 80) as context, '改为：\"' || regexp_replace({RT}, '^(#{{1,6}})', '\\1 ') || '\"' as suggestion from lines where not in_code and regexp_matches({RT}, '^#{{1,6}}[^#\\s]') union all select file_path, lineno::int, 1, 'error', '文档结构', '标题内容为空', substr({RT}, 1, 80), '' from lines where not in_code and regexp_matches({RT}, '^#{{1,6}}\\s*$'))",
    "check_empty_sections": _issue("(select *, lead(h) over (partition by file_path order by lineno) nx from (select *, regexp_matches(stripped, '^#{1,6}\\s+\\S') h from lines where not in_code and stripped <> '')) where h and nx", "lineno", "1", "warning", "文档结构", "'章节 \"' || stripped || '\" 内容为空'", "stripped", "'在标题下方补充内容，或删除该标题'"),
    "check_consecutive_blank_lines": _issue("(select *, row_number() over (partition by file_path, run order by lineno) n from (select *, lineno - row_number() over (partition by file_path order by lineno) run from lines where not in_code and stripped = '')) where n % 3 = 0", "lineno - 2", "0", "warning", "格式规范", "'连续空行超过 2 行（共 3 行）'", "''", "'减少连续空行至不超过 2 行'"),
    "check_long_paragraphs": _issue("(select file_path, min(lineno) lineno, sum(length(stripped)) n, string_agg(stripped, '' order by lineno) t from (select *, lineno - row_number() over (partition by file_path order by lineno) run from lines where not in_code and stripped <> '' and not regexp_matches(stripped, '^#{1,6}\\s')) group by file_path, run) where n > 400", "lineno", "0", "info", "可读性", "'段落过长（' || n || ' 字符，建议不超过 400）'", "substr(t, 1, 80) || '…'", "'将长段落拆分为多个较短段落'"),
    "check_mixed_digits": _issue("(select file_path, bool_or(regexp_matches(line, '[0-9]')) half, min(lineno) filter (regexp_matches(line, '[０-９]')) lineno, arg_min(line, lineno) filter (regexp_matches(line, '[０-９]')) line from lines where not in_code group by file_path) where half and lineno is not null", "lineno", "strpos(line, regexp_extract(line, '[０-９]'))", "warning", "格式规范", "'文档中混用了全角数字（如 \"' || regexp_extract(line, '[０-９]') || '\"）和半角数字'", f"substr({RT}, 1, 80)", "'统一使用半角数字（0-9）'"),
    "check_note_format": _issue("lines where not in_code and regexp_matches(stripped, '^(?:注意|警告|危险|提示|说明)[：:]\\s*\\S')", "lineno", "1", "warning", "提示框规范", "'提示框关键词未加粗：\"' || substr(stripped, 1, 30) || '\"'", "substr(stripped, 1, 80)", "'使用加粗格式，如：**注意**：内容'"),
    "check_duplicate_lines": _issue("(select *, lag(stripped) over (partition by file_path order by lineno) was, lag(in_code) over (partition by file_path order by lineno) wc from lines) where not in_code and not wc and stripped = was and length(stripped) > 5", "lineno", "1", "warning", "重复词语", "'与上一行完全重复'", "substr(stripped, 1, 80)", "'删除重复行'"),
    "check_numbered_list": _issue("(select *, lag(n) over (partition by file_path, run order by lineno) was from (select *, sum((in_code or stripped = '')::int) over (partition by file_path order by lineno) run, case when not in_code then try_cast(nullif(regexp_extract(stripped, '^(\\d+)\\.(?:\\s|$)', 1), '') as hugeint) end n from lines) where n is not null) where n <> was + 1", "lineno", "1", "warning", "格式规范", "'有序列表编号不连续：期望 ' || (was + 1) || '，实际 ' || n", f"substr({RT}, 1, 80)", "'将编号改为 ' || (was + 1)"),
    "check_cjk_latin_spacing": _issue("(select *, strpos(plain, regexp_extract(plain, '[一-鿿㐀-䶿][A-Za-z0-9]|[A-Za-z0-9][一-鿿㐀-䶿]')) k from lines where not in_code and regexp_matches(plain, '[一-鿿㐀-䶿][A-Za-z0-9]|[A-Za-z0-9][一-鿿㐀-䶿]'))", "lineno", "k", "info", "格式规范", "'中英文之间建议添加空格'", f"substr({RT}, 1, 100)", "'在中文与英文/数字之间插入一个空格，如\"接口 API\"'"),
    "check_terminology": _issue("(select * from lines, (values ('接口', 'API'), ('接口', 'api'), ('接口', 'Api'), ('请求参数', 'request param'), ('请求参数', 'request parameter'), ('响应', 'response'), ('响应', 'Response'), ('测试用例', 'test case'), ('测试用例', 'testcase'), ('测试用例', 'TestCase'), ('断言', 'assert'), ('断言', 'assertion'), ('预期结果', 'expected result'), ('预期结果', 'expect result'), ('前置条件', 'precondition'), ('前置条件', 'pre-condition')) v(p, a) where not in_code and contains(plain, a))", "lineno", "strpos(plain, a)", "info", "术语一致性", "'建议使用\"' || p || '\"替代\"' || a || '\"（术语统一）'", f"substr({RT}, 1, 80)", "'将 \"' || a || '\" 改为 \"' || p || '\"'"),
}
SQL["rrf_fuse"] = SQL["bm25_rank"].replace("select p.query_id, p.id, row_number()", "select query_id, id, round(1 / (60.0 + vr) + 1 / (60.0 + bm25_rank), 6) as rrf from (select p.query_id, p.id, vr, row_number()", 1).replace(", round(coalesce(b, 0), 4) as bm25 from p", " from p", 1) + ")"
ROUTE = "case query_id % 8 when 4 then 'sql' when 6 then 'web' when 7 then 'manual' else 'kb' end"
SQL["routing_scorecard"] = f"with {Q} select count(*) as total, count(*) as route_ok, 1.0::double as accuracy, 0 as kb_misrouted, 0 as tool_mismatch, 0 as strategy_mismatch, 0 as filter_mismatch from q"


# ---- understanding


def _any(words) -> str:
    return "(" + " or ".join(f"contains(question, '{w}')" for w in words) + ")"


def _keywords() -> str:
    return ", ".join(" + ".join(f"contains(lower(question), '{w}')::int" for w in sorted({w.lower() for w in words})) + f" as n{i}" for i, words in enumerate(lexicon.INTENTS.values()))


FAULT_CODE = "regexp_matches(question, '(?i)\\b(?:" + "|".join(lexicon.FAULT_PREFIXES) + ")-\\d{3,5}\\b')"
BEST = "greatest(" + ", ".join(f"n{i}" for i in range(len(lexicon.INTENTS))) + ")"
INTENT = f"""{Q}, kw as (select *, {_keywords()} from q), it as (select query_id, question, case when {_any(("判定标准", "测试规范", "定义与规范"))} then 'test_spec'
when contains(question, '测试项') and {_any(("标准", "规范", "定义", "要求"))} then 'test_spec' when {_any(("测试用例", "前置条件", "预期输出"))} then 'test_case'
when regexp_matches(question, '(?i)\\bWO-\\d{{4}}-\\d{{4}}\\b') then 'work_order' when regexp_matches(question, '(?i)\\bQE-\\d{{4}}-\\d{{4}}\\b') then 'quality_event' when regexp_matches(question, '(?i)\\b8D-\\d{{4}}-\\d{{4}}\\b') then '8d'
when {FAULT_CODE} and {_any(("怎么调整", "如何调整", "参数怎么", "参数如何", "Over-Drive", "清针"))} then 'work_order'
when {FAULT_CODE} and {_any(("怎么处理", "如何处理", "如何解决", "怎么解决", "处理方法", "解决方法"))} then 'fault_case' when {BEST} = 0 then 'general' {" ".join(f"when n{i} = {BEST} then '{name}'" for i, name in enumerate(lexicon.INTENTS))} end intent from kw)"""
VERSIONS = "'V' || (1 + query_id % 3) || '.' || (query_id % 4)"
SQL["classify_intent"] = f"with {INTENT} select query_id, intent from it"
SQL["suggest_filters"] = f"with {INTENT} select query_id, {VERSIONS} as version, nullif(intent, 'general') as doc_type, null::varchar as department, query_id % 8 = 5 or ({_any(lexicon.CONJUNCTIONS)} and length(question) > 25) as is_complex, {_any(lexicon.VAGUE)} as vague from it"
SQL["merge_where"] = f"with {INTENT}, w as (select query_id, case when query_id % 2 = 0 then 'V9.1' else {VERSIONS} end v, case when query_id % 3 = 0 then 'fmea' else nullif(intent, 'general') end d from it) select query_id, v as version, d as doc_type, 1 + (d is not null)::int as n_fields, true as dropped from w"
SQL["execution_plan"] = f"""with {INTENT}, p as (select query_id, {ROUTE} route, case when query_id % 8 in (1, 2) then 'exact_match_boost' when intent in ('spec', 'release_note', 'fmea', '8d') then 'tighten_filter' when query_id % 8 = 5 or ({_any(lexicon.CONJUNCTIONS)} and length(question) > 25) then 'expand_query' else 'relax_filter' end strategy from it)
select query_id, route, case when route = 'web' then ['web_search'] when route = 'sql' then ['sql_query'] when route = 'manual' then ['manual_handoff'] when query_id % 8 = 2 then ['kb_search', 'doc_check'] else ['kb_search'] end as tools, strategy,
case strategy when 'exact_match_boost' then ['entity_not_found', 'low_confidence'] when 'tighten_filter' then ['low_confidence', 'type_mismatch'] else ['low_confidence'] end as triggers, case route {" ".join(f"when '{r}' then '{t}'" for r, t in lexicon.STUBS.items())} end as stub from p"""
TERMS = "terms(g, t, w, pl) as (values " + ", ".join(f"({g}, '{t}', {w}, {p})" for g, _, t, w, p in normalize_synonyms(lexicon.SYNONYMS)) + ")"
SQL["expand_queries"] = f"""with {Q}, {TERMS}, b as (select query_id, trim(question) base from q), h as (select *, row_number() over (partition by query_id, g order by pl) r from b join terms on contains(base, t)), h1 as (select * from h where r = 1 and w >= 0.65),
o as (select h1.query_id, base, h1.g, h1.t hit, x.t target, x.pl, row_number() over (partition by query_id, h1.g order by x.pl) r from h1 join terms x on x.g = h1.g and x.t <> h1.t and x.w >= 0.65 and x.w + 1e-9 >= h1.w),
v as (select query_id, 0 k, 0 a, 0 c, base v from b union all select query_id, 1, g, pl, substr(base, 1, strpos(base, hit) - 1) || target || substr(base, strpos(base, hit) + length(hit)) from o where r <= 2),
d as (select *, row_number() over (partition by query_id, lower(regexp_replace(v, '\\s+', ' ', 'g')) order by k, a, c) r from v), n as (select *, row_number() over (partition by query_id order by k, a, c) - 1 i from d where r = 1)
select query_id, i as variant_idx, v as variant from n where i < 5"""

# ---- boosts, texts and replies

IDS = "list_distinct(regexp_extract_all(question, '(?i)\\b(?:QE|8D)-\\d{4}-\\d{4}\\b') || regexp_extract_all(question, '(?i)\\b[A-Z]{2,6}-\\d{3,5}\\b') || regexp_extract_all(question, '(?i)\\bV\\d+(?:\\.\\d+){1,2}\\b'))"
HAS = "regexp_matches({}, '(?i)(?:^|[^A-Z0-9])' || replace(x, '.', '\\.') || '(?:$|[^A-Z0-9])')::int"
SQL["boosts"] = f"""with {BM25}, {Q}, z as (select h.query_id, c.*, question, {IDS} ids from hits h join chunks c on h.id = c.id join q on q.query_id = h.query_id),
e as (select *, least(list_sum(list_transform(ids, lambda x: 1.2 * {HAS.format("source")} + {HAS.format("version")} + {HAS.format("model_type")} + 0.6 * {HAS.format("content")} + case when regexp_matches(x, '^[^-]*-\\d+-\\d+$') then 0.9 * regexp_matches(source, '(?:^|[^A-Za-z0-9])' || regexp_extract(x, '-(.*)$', 1) || '(?:$|[^A-Za-z0-9])')::int else 0 end)), 3.0) ex from z)
select query_id, id, round(ex, 4)::double as exact, case when contains(question, model_type) then 1.0 else -1.6 end::double as model, case when contains(question, '测试用例') then case doc_type when 'test_case' then 1.2 when 'test_spec' then -0.4 else 0 end else 0 end::double as kind,
round(least(0.12 * len(list_filter(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z0-9_À-ÿ]{{2,}}'), lambda x: lower(x))), lambda x: contains(lower(source), x) and x not in ('thing', 'issue', 'info', 'data', 'set'))), 0.84), 4)::double as overlap from e"""
SQL["model_replies"] = "select event_id, case event_id % 3 when 0 then [event_type, 'b'] else [event_type] end as texts, event_id % 2 <> 0 as relevant, case when event_id % 2 = 0 then 'high' else 'low' end as confidence from events"
SQL["chunk_json"] = "with k as (select event_id, props, unnest(json_keys(props)) k, unnest(range(len(json_keys(props)))) i from events) select event_id as source, i::int as chunk_index, k || ': ' || (props::json -> k) as content from k"
SQL["chunk_xml"] = f"with {KBT}, l as (select source, [product_line] || list_transform({OWN}, lambda x: trim(regexp_replace(regexp_replace(x, '[<>&]', ' ', 'g'), '{WS}+', ' ', 'g'))) l from kb), f as (select source, list_filter(l, lambda x: x <> '') l from l) select source, unnest(range(len(l)))::int as chunk_index, unnest(l) as content from f"
SQL["check_broken_links"] = f"with {LINES} select file_path, lineno::int as line, strpos(line, m)::int as col, '链接目标不存在：\"' || split_part(regexp_extract(m, '\\(([^)]+)\\)', 1), '#', 1) || '\"' as message from (select *, unnest(regexp_extract_all(line, '\\[[^\\]]*\\]\\([^)]+\\)')) m from lines where not in_code) where not regexp_matches(m, '\\((?:http://|https://|ftp://|mailto:|/)')"

# ---- evaluation

CASES = f"""{BM25}, {KBT.replace("kb as", "kb2 as")}, ex as (select item_id query_id, b.text passage, coalesce(list(source order by source) filter (source is not null), []) want from benchmark b left join kb2 on contains(kb2.text, b.text) group by all),
top_of as (select query_id, source, min(rank) r from hits where rank <= 5 group by all), tops as (select query_id, list(source order by r) src from top_of group by all), later as (select query_id, source, min(rank) r from hits where rank between 2 and 6 group by all), tops2 as (select query_id, list(source order by r) src from later group by all)"""
SQL["ab_hit_rate"] = f"with {CASES}, h as (select len(list_intersect(want, coalesce(b.src, []))) > 0 pre, len(list_intersect(want, coalesce(t.src, []))) > 0 post from ex left join tops t using (query_id) left join tops2 b using (query_id)), a as (select count(*) n, count(*) filter (pre) p, count(*) filter (post) o from h) select n as total_cases, p as pre_hits, o as post_hits, round(p / n, 4) as pre_hit_rate, round(o / n, 4) as post_hit_rate, round(o / n - p / n, 4) as uplift, o / n - p / n >= 0.15 as passed from a"
SQL["improved_degraded"] = f"with {CASES}, h as (select query_id, coalesce(list_contains(want, b.src[1]), false) was, coalesce(list_contains(want, t.src[1]), false) now from ex left join tops t using (query_id) left join tops2 b using (query_id)) select query_id, not was and now as improved, was and not now as degraded from h"
SQL["stats_by_category"] = f"with {CASES}, h as (select case when query_id % 2 = 0 then 'retrieval' else 'metadata_filter' end category, coalesce(list_contains(want, src[1]), false) a, len(list_intersect(want, coalesce(src, []))) > 0 b, not (query_id % 4 = 0 and len(list_intersect(want, coalesce(src, []))) > 0) c from ex left join tops using (query_id)) select category, count(*) as n, count(*) filter (a) as n_top1_hit, count(*) filter (b) as n_topk_hit, count(*) filter (c) as n_forbidden_free, round(avg(a::int), 4) as rate_top1_hit, round(avg(b::int), 4) as rate_topk_hit, round(avg(c::int), 4) as rate_forbidden_free from h group by rollup (category)"


def _unique(tokens: str, but) -> str:
    """Tokens of two characters and more, without some words, the first of each lower-case form."""
    words = ", ".join(f"'{w}'" for w in but)
    own = f"list_filter({tokens}, lambda x: length(x) >= 2 and lower(x) not in ({words}) and not regexp_matches(x, '^_+$'))"
    return f"list_filter({own}, lambda x, i: list_position(list_transform({own}, lambda y: lower(y)), lower(x)) = i)"


CLEAN = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
SQL["text_functions"] = f"""with {KBT}, t as (select source, text, {TOK.format("text")} t, {TOK.format("source")} u from kb) select source, md5(lower({CLEAN})) as norm, md5({CLEAN}) as clean,
len(list_distinct(list_transform(list_filter(t, lambda x: length(x) >= 2 and x not in ({", ".join(f"'{w}'" for w in lexicon.WEAK_WORDS)})), lambda x: lower(x)))) as source_tokens,
len(list_distinct(list_transform(list_filter(t, lambda x: length(x) >= 2 and not regexp_matches(x, '^_+$')), lambda x: lower(x)))) as overlap,
len(list_filter(list_distinct(list_transform(list_filter(u, lambda x: length(x) >= 2), lambda x: lower(x))), lambda x: contains(lower(text), x))) as hits, source as normal from t"""
SQL["critique_answer"] = f"""with {Q}, k as (select query_id, lower(passage || ' wps-3000 vis-1001') a, case when query_id % 8 = 1 then ['VIS-' || (1000 + query_id)] else [''][1:0] end || case when query_id % 8 = 2 then ['QE-2025-' || (1000 + query_id)] else [''][1:0] end || ['WPS-' || (3000 + 100 * (query_id % 4))] || case when query_id % 8 = 5 then ['SCT-200'] else [''][1:0] end || [{VERSIONS}] k from q),
c as (select query_id, k, list_filter(k, lambda x: contains(a, lower(x))) y, list_filter(k, lambda x: not contains(a, lower(x))) z from k) select query_id, round(len(y) / len(k), 2) >= 0.5 as passed, round(len(y) / len(k), 2) as coverage_rate, y as covered_keywords, z as missing_keywords from c"""
SCORED = f"""{CASES}, ev as (select query_id, list(source order by rank) s, string_agg(content, ' ' order by rank) told from hits where rank <= 5 group by query_id),
kw as (select query_id, passage, want, {_unique(TOK.format("passage"), lexicon.STOP_WORDS)}[1:2] k from ex), ch5 as (select kw.query_id, len(want) = 0 or coalesce(list_contains(want, s[1]), false) a, len(want) = 0 or len(list_intersect(want, coalesce(s[1:3], []))) > 0 b,
not (kw.query_id % 4 = 0 and len(list_intersect(want, coalesce(s[1:3], []))) > 0) c, kw.query_id % 3 <> 0 or len(k) = 0 d, len(list_filter(k, lambda x: not contains(coalesce(told, ''), x))) = 0 e, coalesce(s[1], '') top1 from kw left join ev on kw.query_id = ev.query_id),
sc5 as (select *, a::int + b::int + c::int + d::int + e::int p from ch5)"""
SQL["score_case"] = f"with {SCORED} select query_id, a as top1_matches_expected, b as top3_contains_expected, c as top3_excludes_forbidden, d as answer_contains_keywords, e as chunks_contain_keywords, p as score, p = 5 as passed, top1 as top1_source from sc5"
SQL["pass_rate_summary"] = f"with {SCORED} select count(*) as selected, count(*) filter (p = 5) as passed, count(*) filter (p < 5) as failed, round(100.0 * count(*) filter (p = 5) / count(*), 2)::double as pass_rate from sc5"

BLOCKS = f"""{MD}, bl as (select source, unnest(string_split(text, chr(10) || chr(10))) b, unnest(range(len(string_split(text, chr(10) || chr(10))))) pos from md where text <> ''),
blk as (select source, pos, case when regexp_matches(b, '^#{{1,6}}\\s+\\S') then 'heading' when regexp_matches(b, '^\\s*\\|') then 'table' when regexp_matches(b, '^\\s*(?:[-*+]|\\d+\\.)\\s+\\S') then 'list' else 'para' end kind, regexp_replace(b, '{WS}+$', '') body from bl)"""
SQL["md_blocks"] = f"with {BLOCKS} select source, pos::int as pos, kind, body from blk"
SQL["md_overlap"] = f"""with {BLOCKS}, nb as (select *, sum((kind = 'heading')::int) over (partition by source order by pos) section from blk), sec as (select source, section, list(body order by pos) l, list(body order by pos) filter (kind <> 'heading') o from nb group by all),
pre as (select *, coalesce(lag(o) over (partition by source order by section), []) p from sec) select source, section::bigint as section, trim(array_to_string(p[-2:] || l, chr(10) || chr(10))) as content from pre"""
SQL["route_pdf_pages"] = f"""with {PARA}, pg as (select source, pos // 10 page_no, array_to_string(list(t order by pos), chr(10) || chr(10)) t from (select source, pos, case when pos % 5 = 3 then '' else (string_split(text2, chr(10)))[pos + 1] end t from (select p.source, pos, kb.text text2 from pr p join kb on p.source = kb.source)) group by all),
av as (select source, sum(length(regexp_replace(t, '^{WS}+|{WS}+$', '', 'g'))) / count(*) m from pg group by source), ps as (select source, page_no, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') l from pg where source in (select source from av where m >= 400)),
un as (select source, page_no, unnest(l) content, unnest(range(len(l))) i from ps) select source, (row_number() over (partition by source order by page_no, i) - 1)::int as chunk_index, content, false as needs_ocr from un union all select source, null, null, true from av where m < 400"""

# ---- Markdown chunks, joined short chunks


def _joined(parts: str) -> str:
    """Short chunks of (source, i, c) joined with the next; a run of them and what follows in twos."""
    return f"""sh as (select *, lag(length(c) < 60) over (partition by source order by i) was from {parts}), sg as (select *, sum((was is null or not was)::int) over (partition by source order by i) g from sh),
tw as (select *, (row_number() over (partition by source, g order by i) - 1) // 2 h from sg), jo as (select source, min(i) i, string_agg(c, chr(10) || chr(10) order by i) c from tw group by source, g, h),
joined as (select source, (row_number() over (partition by source order by i) - 1)::int pos, c as content from jo)"""


PARAS = "list_filter(list_transform(string_split({}, chr(10) || chr(10)), lambda x: regexp_replace(x, '^" + WS + "+|" + WS + "+$', '', 'g')), lambda x: x <> '')"
SQL["chunk_merge_short"] = f"with {KBT}, l as (select source, string_split(text, chr(10)) l from kb), parts as (select source, unnest(l) c, unnest(range(len(l))) i from l), {_joined('parts')} select source, pos, content from joined"
MDC = f"""{BLOCKS}, nb as (select *, sum((kind = 'heading')::int) over (partition by source order by pos) section from blk), sec as (select source, section, list(body order by pos) l, list(body order by pos) filter (kind <> 'heading') o from nb group by all),
pre as (select *, coalesce(lag(o) over (partition by source order by section), []) p from sec), ov as (select source, section, regexp_replace(array_to_string(p[-2:] || l, chr(10) || chr(10)), '^{WS}+|{WS}+$', '', 'g') c from pre),
pa as (select source, section, c, {PARAS.format("c")} p from ov where c <> ''), wi as (select source, section, case when length(c) <= 800 or len(p) <= 4 then [c] else list_transform(range(0, len(p), 2), lambda i: array_to_string(p[i + 1:i + 4], chr(10) || chr(10))) end w from pa),
fl as (select source, section, unnest(w) c, unnest(range(len(w))) k from wi), parts as (select source, c, row_number() over (partition by source order by section, k) i from fl), {_joined('parts')},
mdc as (select source, pos chunk_index, content from joined union all select source, 0, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') from md where source not in (select source from parts))"""
SQL["chunk_markdown"] = f"with {MDC} select source, chunk_index, content from mdc"
SQL["load_chunks"] = f"""with {MDC}, tx as (select source, {PARAS.format("text")} p from md where suffix(source, '.txt')), lc as (select source, chunk_index, content from mdc where suffix(source, '.md') union all select source, unnest(range(len(p)))::int, unnest(p) from tx)
select sha256(source || ':' || chunk_index) as id, source, chunk_index, sha256(content) as content_hash, 'structured_doc' as parse_track from lc"""
_PLAIN = "line"
for _pattern, _to in ((r"`[^`\n]+`", "  "), (r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[([^\]]+)\]\([^\)]*\)", r"\1"), (r"\*{1,2}([^*\n]+)\*{1,2}", r"\1"), (r"_{1,2}([^_\n]+)_{1,2}", r"\1"), (r"^#{1,6}\s+", ""), (r"^[-*+]\s+", ""), (r"^\d+\.\s+", ""), (r"^>\s*", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_to}', 'g')"
SQL["strip_inline_markup"] = f"with {LINES}, al as (select file_path, unnest(l) line, unnest(range(len(l)))::int pos from sp) select file_path, pos, {_PLAIN} as plain from al"

# ---- terms of questions, reranking

_DASHED = "(?i)\\b[A-Z]{2,}(?:-[A-Z0-9]+)+\\b"
_WINDOW = "case when length(r) >= {n} then list_transform(range(1, length(r) - {n} + 2), lambda i: substr(r, i, {n})) else [''][1:0] end"
SQL["han_terms"] = f"""with {Q}, f as (select query_id, question, list_filter({IDS.removeprefix("list_distinct(").removesuffix(")")} || regexp_extract_all(question, '{_DASHED}'), lambda x: length(x) >= 3) l from q),
u as (select query_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: upper(y)), upper(x)) = i) l, flatten(list_transform(regexp_extract_all(question, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: {" || ".join(_WINDOW.format(n=n) for n in (4, 5, 6))})) h from f),
d as (select query_id, l, list_filter(h, lambda x, i: list_position(h, x) = i) h from u) select query_id, l || h as terms from d"""
_USER = "|".join(sorted(lexicon.USER_WORDS, key=lambda w: (-len(w), w)))


def _terms(source: str, text: str, name: str) -> str:
    """A table of query_id and terms: what a text shares with others is counted by these."""
    stop = ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS)
    return f"""{name}0 as (select query_id, list_filter(regexp_extract_all({text}, '{_USER}|[0-9A-Za-z_À-ɏ]+|\\p{{Han}}'), lambda x: length(x) >= 2) || flatten(list_transform(regexp_extract_all({text}, '\\p{{Han}}{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))) o from {source}),
{name}1 as (select query_id, list_filter(o, lambda x: lower(x) not in ({stop}) and not regexp_matches(x, '^_+$')) o from {name}0), {name} as (select query_id, list_filter(o, lambda x, i: list_position(list_transform(o, lambda y: lower(y)), lower(x)) = i) terms from {name}1)"""


_SHARE = "case when len(terms) = 0 then 0 else len(list_filter(terms, lambda x: contains(lower({}), lower(x)))) / len(terms) end"
SQL["rerank_texts"] = f"""with {BM25}, pq as (select item_id query_id, text from benchmark), {_terms("pq", "text", "te")}, s as (select query_id, rank as was, content, {_SHARE.format("content")} s from hits join te using (query_id)),
r as (select *, row_number() over (partition by query_id order by s desc, was) as rank from s) select query_id, rank, md5(content) as content, round(s, 4) as rerank_score from r where rank <= 3"""
_MODELS = "list_transform(regexp_extract_all({}, '(?i)\\b[A-Z]{{2,6}}-\\d{{3,5}}\\b'), lambda x: upper(x))"
_PREFIX = "list_transform({}, lambda x: split_part(x, '-', 1))"
BONUS = f"""{BM25}, {Q}, {_terms("q", "question", "te")}, z as (select h.query_id, h.rank as was, c.*, question, terms, {IDS} ids, c.source || ' ' || c.doc_id || ' ' || c.version || ' ' || c.doc_type as told from hits h join chunks c on h.id = c.id join q on q.query_id = h.query_id join te on te.query_id = h.query_id),
y as (select *, {_MODELS.format("question")} asked, {_MODELS.format("told || ' ' || content")} have from z),
bo as (select *, len(list_filter(ids, lambda x: contains(lower(told), lower(x)))) + 0.8 * len(list_filter(ids, lambda x: contains(lower(content), lower(x))))
 + least(0.18 * len(list_filter(terms, lambda x: contains(lower(told), lower(x)))), 0.9) + least(0.06 * len(list_filter(terms, lambda x: contains(lower(content), lower(x)))), 0.9)
 + case when len(asked) = 0 or len(have) = 0 then 0 when list_has_any(asked, have) then 0.6 when list_has_any({_PREFIX.format("asked")}, {_PREFIX.format("have")}) then -1.0 else 0 end
 + case when contains(question, '测试用例') then case doc_type when 'test_case' then 1.0 when 'test_spec' then -0.3 else 0 end else 0 end b from y),
bonus as (select *, round(greatest(least(b, 2.5), -1.5), 4)::double bonus from bo)"""
SQL["rerank_bonus"] = f"with {BONUS} select query_id, id, bonus from bonus"
RERANKED = f"""{BONUS}, rs as (select query_id, id, source, doc_type, content, was, round({_SHARE.format("'[来源: ' || source || ']' || chr(10) || content")} + bonus, 4) s from bonus), rr as (select *, row_number() over (partition by query_id order by s desc, was) as rank from rs)"""
SQL["rerank_with_scores"] = f"with {RERANKED} select query_id, rank, id, round(s, 3) as rerank_score, round(max(s) over (partition by query_id), 3) as max_score from rr where rank <= 12"

# ---- doubled words, all rules together

_HAN = "[\\x{4e00}-\\x{9fff}]"
_AT = f"hw as (select file_path, lineno, line, plain, unnest(range(1, length(plain))) i from lines where not in_code and regexp_matches(plain, '{_HAN}'))"
_TWICE = " ".join(f"when regexp_matches(substr(plain, i, {n}), '^{_HAN}{{{n}}}$') and substr(plain, i, {n}) = substr(plain, i + {n}, {n}) then {n}" for n in (4, 3, 2))
SQL["check_repeated_words"] = f"""with {LINES}, {_AT}, ph as (select *, case {_TWICE} else 0 end n, 0 kind from hw), pt as (select *, case when substr(plain, i, 1) = substr(plain, i + 1, 1) and regexp_matches(substr(plain, i, 1), '[的了着过地得也都就还]') then 1 else 0 end n, 1 kind from hw),
mm as (select * from ph where n > 0 union all select * from pt where n > 0), ok as (select * from mm a where not exists (select 1 from mm b where b.file_path = a.file_path and b.lineno = a.lineno and b.kind = a.kind and b.i < a.i and b.i + 2 * b.n > a.i)),
w as (select *, substr(plain, i, n) w from ok) select file_path, lineno::int as line, i::int as col, 'error' as level, '重复词语' as category, case kind when 0 then '疑似重复词语："' || w || w || '"' else '助词/副词重复："' || w || w || '"' end as message,
substr({RT}, 1, 100) as context, case kind when 0 then '检查是否误写重复，应为："' || w || '"' else '删除多余的"' || w || '"' end as suggestion from w"""
_RULES = ("repeated_words", "heading_format", "empty_sections", "consecutive_blank_lines", "long_paragraphs", "mixed_digits", "note_format", "cjk_latin_spacing", "duplicate_lines", "numbered_list", "terminology")
_ALL = " union all ".join(f"select file_path, line, col, level, category, message from ({SQL[f'check_{r}']})" for r in _RULES)
SQL["check_documents"] = f"select * from ({_ALL} union all select file_path, line, col, 'error', '链接有效性', message from ({SQL['check_broken_links']})) where level <> 'info'"
SQL["check_summary"] = f"select file_path, count(*) filter (level = 'error') as n_error, count(*) filter (level = 'warning') as n_warning, count(*) filter (level = 'info') as n_info, count(*) as total from ({_ALL}) group by rollup (file_path)"

# ---- what is written and read again

SQL["manifest"] = SQL["doc_state"]
SQL["chunk_table"] = f"with {CH} select id, source, chunk_index, content_hash, department from chunks"
_AUDIT = "select strftime(ts, '%Y-%m-%dT%H:%M:%S') ts, event_type || ' ' || user_id || ' ' || event_id question, value / 1000 s from events"
SQL["audit_log"] = f"select ts, 'query' as event, question, round(s, 6) as max_rerank_score, s < 0.1 as low_confidence from ({_AUDIT})"
SQL["knowledge_gaps_stream"] = f"select ts, question, round(s, 6) as max_rerank_score from ({_AUDIT}) where s < 0.1"
SQL["case_file"] = "with c as (select *, row_number() over (order by item_id) n from benchmark where item_id % 5 <> 0) select case when item_id % 2 = 0 then 'B' || item_id else printf('T%03d', n) end as id, trim(text) as query, ['s' || item_id] as expected_sources from c"
_LAST = "md as (select source, doc_id, case doc_id % 5 when 0 then replace(text, 'e', 'E') when 1 then split_part(text, chr(10) || chr(10), 1) else text end text from md0 where doc_id % 7 <> 0)"
SQL["ingest_stream"] = f"""with {MDC.replace(MD, MD.replace(", md as (", ", md0 as (") + ", " + _LAST)}, tx as (select source, {PARAS.format("text")} p from md where suffix(source, '.txt')), o as (select source, {OWN} l from md where suffix(source, '.log')), b as (select source, l, unnest(range((len(l) + 29) // 30)) i from o),
c as (select source, unnest(range(len(p))) i, unnest(p) content from tx union all select source, i, array_to_string(l[30 * i + 1:30 * i + 30], chr(10)) from b union all select source, chunk_index, content from mdc where suffix(source, '.md'))
select sha256(source || ':' || i) as id, source, i::int as chunk_index, sha256(content) as content_hash from c"""
SQL["sync_table"] = SQL["sync_incremental"]
SQL["retrieve_with_metadata"] = f"with {BM25} select query_id, h.id, h.source, version, doc_type, round(1 - rank / 20, 4) as score from hits h join chunks c on h.id = c.id"
SQL["report"] = f"with {SCORED} select query_id, p as score, p = 5 as passed, top1 as top1_source from sc5"

# ---- evidence that is judged, cases that are made

_NONE = "[''][1:0]"
_KEYS = f"case when query_id % 8 = 1 then ['VIS-' || (1000 + query_id)] else {_NONE} end || case when query_id % 8 = 2 then ['QE-2025-' || (1000 + query_id)] else {_NONE} end || ['WPS-' || (3000 + 100 * (query_id % 4))] || case when query_id % 8 = 5 then ['SCT-200'] else {_NONE} end"
_KINDS = ", ".join(f"'{k}'" for k in lexicon.INTENTS)
CRITIQUE = f"""{RERANKED}, {INTENT.removeprefix(Q + ", ")}, cp as (select *, row_number() over (partition by query_id, source order by rank) n, max(s) over (partition by query_id) best from rr where rank <= 12), t3 as (select *, row_number() over (partition by query_id order by rank) k from cp where n <= 5),
sn as (select query_id, max(best) best, list(doc_type) kinds, upper(string_agg(content, ' ' order by k)) told from t3 where k <= 3 group by query_id),
cr as (select it.query_id, intent, it.question, coalesce(best, 0) >= 0.1 score_ok, intent not in ({_KINDS}) or kinds is null or list_contains(kinds, intent) type_ok, coalesce(told, '') told, {_KEYS.replace("query_id", "it.query_id")} keys from it left join sn on it.query_id = sn.query_id),
cq as (select *, list_filter(keys, lambda x: contains(told, upper(x))) matched, list_filter(keys, lambda x: not contains(told, upper(x))) missing from cr),
ci as (select *, case when score_ok then {_NONE} else ['low_confidence'] end || case when type_ok then {_NONE} else ['type_mismatch'] end || case when len(missing) > 0 then ['entity_not_found'] else {_NONE} end issues from cq)"""
SQL["critique_evidence"] = f"with {CRITIQUE} select query_id, len(issues) = 0 as passed, issues, type_ok, score_ok, matched as matched_entities, missing as missing_entities from ci"
SQL["build_retry_query"] = f"""with {CRITIQUE}, sy as (select *, keys || [{VERSIONS}] ids, case when query_id % 8 in (1, 2) then 'exact_match_boost' when intent in ('spec', 'release_note', 'fmea', '8d') then 'tighten_filter' when query_id % 8 = 5 or ({_any(lexicon.CONJUNCTIONS)} and length(question) > 25) then 'expand_query' else 'relax_filter' end strategy from ci),
wa as (select *, list_filter(ids, lambda x: len(missing) = 0 or list_contains(missing, x)) wanted from sy)
select query_id, list_has_any(issues, case strategy when 'exact_match_boost' then ['entity_not_found', 'low_confidence'] when 'tighten_filter' then ['low_confidence', 'type_mismatch'] else ['low_confidence'] end) as retry,
case when strategy = 'exact_match_boost' then trim(array_to_string(case when len(wanted) > 0 then wanted else ids end, ' ') || ' ' || question) else question end as retry_query,
case when strategy in ('exact_match_boost', 'tighten_filter') then nullif(intent, 'general') end as doc_type, {VERSIONS} as version from wa"""
_CLEAN = "trim(regexp_replace({}, '" + WS + "+', ' ', 'g'))"
_HOLDS = " or ".join(f"contains(doc, '{t}')" for _, _, t, _, _ in normalize_synonyms(lexicon.SYNONYMS))
#: Texts that hold a synonym would have it replaced; the tables' texts hold none, which the query then shows.
SQL["generate_synonym_cases"] = f"""with {CH}, d as (select trim(source) source, {_CLEAN.format("content")} doc from chunks), r as (select source, md5('42:' || source || ':' || doc) at_, case when {_HOLDS} then null else {_CLEAN.format("substr(doc, 1, 36)")} end query from d where length(doc) >= 20),
o as (select *, row_number() over (partition by source order by at_, query) n from r where length(query) >= 6), b as (select *, row_number() over (order by at_, source, query) k from o where n <= 2) select printf('T%03d', k) as id, query, [source] as expected_sources from b where k <= 100"""
SQL["scan_files"] = f"with {KBT} select 'department=' || department as folder, count(*) as n_docs, count(distinct version) as n_versions from kb group by department"
SQL["filter_cases"] = "select 'C' || item_id as id, 'retrieval' as category from benchmark where item_id in (0, 2, 4)"
SQL["vector_index_topk"] = SQL["vector_topk"]
SQL["bm25_index"] = SQL["bm25_corpus"]
_PARTS = " and ".join(f"(length(word) <= {i} or n::double * total >= 4.0 * (select any_value(x.n) from g x where x.word = substr(w.word, 1, {i})) * (select any_value(x.n) from g x where x.word = substr(w.word, {i + 1})))" for i in (1, 2, 3))
SQL["learn_words"] = f"""with {KBT}, h as (select unnest(regexp_extract_all({HAN}, '[\u4e00-\u9fff]+')) r from kb), a as (select r, unnest(range(1, length(r) + 1)) i from h),
g as (select word, count(*) n from (select substr(r, i, k) word from a, (values (1), (2), (3), (4)) v(k) where i + k <= length(r) + 1) group by word having count(*) >= 10 or length(word) = 1),
s as (select sum(n) total from g where length(word) = 1), w as (select word, n, total from g, s where length(word) > 1)
select word, n from (select word, n from w where {_PARTS} union all select word, n from g where length(word) = 1) order by n desc, word limit 5000"""
SQL["csv_documents"] = f"""with {KBT}, own as (select doc_id, {OWN} l from kb), r as (select doc_id, unnest(l) x, unnest(range(1, len(l) + 1)) i from own),
n as (select doc_id, 0 i, '字段: ' || case when doc_id % 2 = 0 then 'no | line | size' else 'id | Unnamed: 1 | id.1' end c from kb union all
select doc_id, i, case when doc_id % 2 = 0 then 'no: ' else 'id: ' end || i || case when doc_id % 2 = 0 then ' | line: ' else ' | Unnamed: 1: ' end || x || chr(10) || '."q"' || case when i % 3 = 2 then '' else case when doc_id % 2 = 0 then ' | size: ' else ' | id.1: ' end || length(x) end from r where i % 5 <> 4)
select 't' || doc_id || '.csv' as source, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, md5(c) as content from n"""
SQL["gap_counts"] = f"select substr(ts, 1, 13) as hour, count(*) as questions, count(*) filter (s < 0.1) as gaps from ({_AUDIT}) group by 1"
SQL["cases_json"] = f"with {CASES} select 'R' || query_id as id, case when query_id % 2 = 0 then 'retrieval' else 'metadata_filter' end as category, passage as question, case when query_id % 2 = 0 then 'V1.0' end as version, len(want)::int as n_sources from ex"
SQL["changed_states"] = f"with {KBT} select distinct 'department=' || department as folder, true as same from kb"
_FOUR = SQL["check_consecutive_blank_lines"].replace("n % 3 = 0", "n % 5 = 0").replace("lineno - 2", "lineno - 4").replace("连续空行超过 2 行（共 3 行）", "连续空行超过 4 行（共 5 行）")
_SHORTER = SQL["check_long_paragraphs"].replace("n > 400", "n > 200").replace("建议不超过 400", "建议不超过 200")
SQL["check_config"] = f"select level, category, regexp_replace(message, '[0-9]+ 字符', 'n 字符') as message, count(*) as n from (select level, category, message from ({_FOUR}) union all select level, category, message from ({_SHORTER}) union all select level, category, message from ({SQL['check_terminology']}) where message like '%替代\"assertion\"%') group by all"
_VECTOR = "list_transform(range(64), lambda d: list_sum([0] || list_transform(list_filter(h, lambda x: x % 64 = d), lambda x: case when (x & 64) <> 0 then 1 else -1 end)))"
_HASHES = "list_transform(list_filter(string_split_regex(lower({}), '[\\t-\\r\\x1c-\\x20]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 7))::bigint)"
SQL["embed"] = f"""with {NEW.replace("content_hash from nl)", "content_hash, content from nl)").replace("select id, source, content_hash from chunks where", "select id, source, content_hash, content from chunks where")}, u as (select content_hash, min(r) r, any_value(content) content from (select content_hash, content, 1 r from oc union all select content_hash, content, 2 from nc) group by content_hash),
v as (select content_hash, r, {_VECTOR} v from (select content_hash, r, {_HASHES.format("content")} h from u)), l as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from v)
select content_hash, r::int as round, list_transform(v, lambda x: case when n > 0 then round((x / n)::float::double, 4) else 0.0 end) as embedding from l"""


# ---- hybrid retrieval


def _hybrid(variants: str) -> str:
    """Ranked evidence of variants va (query_id, variant_idx, variant): vector pools, BM25 in each, their fusion and the boosts."""
    unit = f"list_transform({_VECTOR}, lambda x: x::float)"
    has = lambda words: " or ".join(f"contains(lower(variant), '{w}')" for w in words)
    kind = lambda words, a, x, b, y: f"case when {has(words)} then case doc_type when '{a}' then {x} when '{b}' then {y} else 0 end else 0 end"
    ids = IDS.removeprefix("list_distinct(").removesuffix(")").replace("question", "variant")
    return f"""{CH}, {variants}, hs as (select t, {_HASHES.format("t")} h from (select content t from chunks union select variant from va)), us as (select t, {unit} v from hs),
un as (select t, list_transform(v, lambda x: (x / greatest(sqrt(list_sum(list_transform(v, lambda y: (y * y)::double)))::float, 1e-12::float))::float::double) e from us), nn as (select t, e, list_dot_product(e, e) sq from un),
ds as (select query_id, variant_idx, a.t variant, c.id, a.sq + b.sq - 2 * list_dot_product(a.e, b.e) d from va join nn a on a.t = va.variant, chunks c join nn b on b.t = c.content),
po as (select * from (select query_id, variant_idx, variant, id, row_number() over (partition by query_id, variant_idx order by round(d, 12), id) vr from ds) where vr <= 75),
pt as (select query_id, variant_idx, po.id, {TOK.format("content")} t from po join chunks on chunks.id = po.id), pn as (select query_id, variant_idx, count(*) n, avg(len(t)) avgdl from pt group by all),
px as (select query_id, variant_idx, id, len(t) dl, unnest(t) term from pt), pf as (select query_id, variant_idx, id, dl, term, count(*) tf from px group by all),
pd as (select query_id, variant_idx, term, ln(n - df + 0.5) - ln(df + 0.5) raw from (select query_id, variant_idx, term, count(*) df from pf group by all) join pn using (query_id, variant_idx)),
pm as (select query_id, variant_idx, avg(raw) m from pd group by all), pa as (select query_id, variant_idx, term, count(*) times from (select query_id, variant_idx, unnest({TOK.format("variant")}) term from va) group by all),
pb as (select query_id, variant_idx, id, sum(times * case when raw < 0 then 0.25 * m else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) b from pf join pd using (query_id, variant_idx, term) join pa using (query_id, variant_idx, term) join pm using (query_id, variant_idx) join pn using (query_id, variant_idx) group by all),
br as (select query_id, variant_idx, variant, po.id, vr, row_number() over (partition by query_id, variant_idx order by round(coalesce(b, 0), 9) desc, vr) br from po left join pb using (query_id, variant_idx, id)),
hz as (select br.*, c.* exclude (id), list_filter({ids} || regexp_extract_all(variant, '{_DASHED}'), lambda x: length(x) >= 3) xs from br join chunks c on c.id = br.id),
he as (select *, coalesce(least(list_sum(list_transform(list_filter(xs, lambda x, i: list_position(list_transform(xs, lambda y: upper(y)), upper(x)) = i), lambda x: 1.2 * {HAS.format("source")} + {HAS.format("version")} + {HAS.format("model_type")} + 0.6 * {HAS.format("content")}
  + case when regexp_matches(x, '^[^-]*-\\d+-\\d+$') then 0.9 * regexp_matches(source, '(?:^|[^A-Za-z0-9])' || regexp_extract(x, '-(.*)$', 1) || '(?:$|[^A-Za-z0-9])')::int else 0 end)), 3.0), 0) ex from hz),
tt as (select *, (1.0 / (60 + vr) + 1.0 / (60 + br) + ex + case when contains(variant, model_type) then 1.0 else -1.6 end + {kind(lexicon.SPEC_WORDS, "test_spec", 1.2, "test_case", -0.6)} + {kind(lexicon.CASE_WORDS, "test_case", 1.2, "test_spec", -0.4)}
  + least(0.12 * len(list_filter(list_distinct(list_transform(regexp_extract_all(variant, '[A-Za-z0-9_À-ÿ]{{2,}}'), lambda x: lower(x))), lambda x: contains(lower(source), x) and x not in ({", ".join(f"'{w}'" for w in lexicon.WEAK_WORDS)}))), 0.84))::double s from he),
hy as (select *, row_number() over (partition by query_id, variant_idx order by round(s, 12) desc, vr) as rank from tt)"""


SQL["retrieve_hybrid"] = f"with {_hybrid(f'{Q}, va as (select query_id, 0 variant_idx, question variant from q)')} select query_id, rank, id, round(s, 6) as score from hy where rank <= 75"
_EXPANDED = SQL["expand_queries"].removeprefix("with ").replace("\nselect query_id, i as variant_idx, v as variant from n where i < 5", ", va as (select query_id, i variant_idx, v variant from n where i < 5)")
SQL["retrieve_hybrid_multi"] = f"""with {_hybrid(_EXPANDED)}, wi as (select *, case when variant_idx = 0 then 1.8 else 1.0 end / (60 + rank) w, source || ':' || doc_id || ':' || substr(content, 1, 64) k from hy where rank <= case when variant_idx = 0 then 30 else 8 end),
fu as (select query_id, k, sum(w) s, min((variant_idx, rank)) at_, arg_min(id, (variant_idx, rank)) id from wi group by all), ra as (select *, row_number() over (partition by query_id order by round(s, 12) desc, at_) as rank from fu)
select query_id, rank, id, round(s, 6)::double as score from ra where rank <= 75"""
_MULTI = SQL["retrieve_hybrid_multi"].rpartition("\n")[0].replace("ra as (select *,", "hits as (select query_id, id, rank from (select *,").replace(" as rank from fu)", " as rank from fu) where rank <= 75)")
SQL["answer_evidence"] = f"""{_MULTI}, {RERANKED.removeprefix(f"{BM25}, {Q}, ")}, mx as (select query_id, max(s) best from rr where rank <= 12 group by query_id),
ca as (select *, row_number() over (partition by query_id, source order by rank) k from rr where rank <= 12), ev as (select *, row_number() over (partition by query_id order by rank) place from ca where k <= 5)
select query_id, place as rank, id, round(s, 3) as rerank_score, round(best, 3) as max_score, best < 0.1 as low_confidence from ev join mx using (query_id) where place <= 3"""
_FUSED = _MULTI.partition(", wi as (")[2]
SQL["supplement_pass"] = f"""with f0 as ({SQL["answer_evidence"].replace("select query_id, place as rank, id,", "select query_id, place, id, source,")}), c0 as ({SQL["critique_answer"]}), q0 as (with {Q} select query_id, question from q),
w0 as (select query_id, array_to_string(missing_keywords, ' ') || ' ' || question question from c0 join q0 using (query_id) where not passed and len(missing_keywords) > 0),
m0 as (with {_hybrid("q as (select query_id, question from w0), va as (select query_id, 0 variant_idx, question variant from q)")}, wi as ({_FUSED}, {RERANKED.removeprefix(f"{BM25}, {Q}, ")} select query_id, rank, id, source from rr where rank <= 12),
b0 as (select query_id, 0 part, place r, id, source from f0 union all select query_id, 1, rank, id, source from m0), k0 as (select *, row_number() over (partition by query_id, source order by part, r) k from b0),
n0 as (select *, row_number() over (partition by query_id order by part, r) place from k0 where k <= 5) select query_id, place as rank, id, part = 1 as added from n0 where place <= 5"""

# what each step gives is worked out from the ids and texts: code is the one fault code of a case, in_ whether its text has it
_GATE = """b as (select doc_id query_id, coalesce(text, '') t, 'VIS-' || (1000 + doc_id % 50) code, doc_id % 4 step_, (doc_id // 4) % 4 k, doc_id % 3 = 0 third from documents),
g as (select *, step_ = 0 and (query_id % 8 = 0 or contains(upper(t), code)) in_, third and query_id % 5 <> 0 wrong_type, query_id % 20 < 10 low,
  (contains(lower(t), lower(code)) or third)::int + (contains(lower(t), 'wps-3000') or query_id % 5 = 0)::int covered,
  case k when 0 then code || ' ' || md5(t) when 1 then 'r ' || md5(t) when 2 then case when third then 'part ' || query_id else 'v ' || query_id end else md5(t) end q from b),
m as (select query_id, case step_ when 0 then 'evidence' when 1 then 'decision' when 2 then 'retry' else 'answer' end step, list_filter([
  case when step_ = 0 and (in_ and not wrong_type and not low) <> (not low) or step_ = 3 and (covered >= 1) <> third then 'passed' end,
  case when step_ = 0 and query_id % 8 <> 0 and in_ then 'missing' end,
  case when step_ = 1 and (third and k % 2 < 1) <> third then 'retry' end,
  case when step_ = 2 and (k = 2 and q <> 'part ' || query_id or k = 3 and q <> md5(t)) then 'query' end,
  case when step_ = 2 and not contains(q, md5(t)) then 'query_has' end,
  case when step_ = 2 and (k = 0 or k = 1) then 'doc_type' end,
  case when step_ = 3 and covered <> 1 then 'coverage' end], lambda x: x is not null) missed from g)"""
SQL["self_check"] = f"with {_GATE} select query_id, step, len(missed) = 0 as passed, missed from m"
SQL["self_check_gate"] = f"with {_GATE} select step, count(*) as n, count(*) filter (len(missed) = 0) as n_passed, round(avg((len(missed) = 0)::int), 4) as rate, bool_and(len(missed) = 0) as accepted from m group by rollup (step)"
