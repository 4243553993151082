"""The registered queries in the SQL of another engine, over views of the same tables."""

from __future__ import annotations

from ..functions.constants import ALIASES, ARCHITECTURE, ARXIV, DATASET_SHAPE, DATASETS, DOI, GAPS, HARDWARE, HEADING_END, HEADING_PREFIX, HYPERPARAMETERS, LOWER_IS_BETTER, MATH, MATH_SPAN, METRICS, NO_TEXT, NUMBER, PRIORITY, RUN_ON, SCORES, SECTIONS, SENTENCE_END, SENTENCE_START, TASK, THEMES, TOKEN, YEAR
from ..operators.metadata import AFFILIATION, NO_NAME
from ..sources.corpus import PAGE_TEXT_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(p: str) -> tuple[str, str]:
    return _q(p.removeprefix("(?i)")), "'i'" if p.startswith("(?i)") else "'c'"


def _list(names) -> str:
    return "[" + ", ".join(map(_q, names)) + "]"


_NAMES = {a: s for s, names in ALIASES.items() for a in names}
_CANON = "map {" + ", ".join(f"{_q(a)}: {_q(s)}" for a, s in _NAMES.items()) + "}"
_HEADING = "^" + HEADING_PREFIX + "(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + ")" + HEADING_END + "$"
_ORD = f"(list_position({_list(SECTIONS)}, section) - 1)::int"
_PRIORITY = _list(PRIORITY)
_TAG = "paragraph_id || '|' || page_number || '|' || section"
_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _latex(c: str) -> str:
    for a, b in MATH.items():
        c = f"replace({c}, {_q(a)}, {_q(f' {b} ')})"
    return _strip(rf"regexp_replace({c}, '[ \t]+', ' ', 'g')")


def _sentences(c: str) -> str:
    marked = rf"regexp_replace({c}, '({SENTENCE_END})\s+({SENTENCE_START})', '\1' || chr(1) || '\2', 'g')"
    cut = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
    return f"(case when len({cut}) > 0 then {cut} else [trim({c})] end)"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {_q(TOKEN)})"


_LEAD = f"({_sentences('text')})[1]"
_PAGES = f"pages as ({PAGE_TEXT_SQL})"
_LINES = rf"""{_PAGES},
cut as (select paper_id, page_number, string_split(text, chr(10)) as l from pages),
cut2 as (select paper_id, page_number, case when l[-1] = '' then l[:-2] else l end as l from cut),
lines as (
  select paper_id, page_number, k - 1 as line_no, {_strip('l[k]')} as line
  from (select *, unnest(range(1, len(l) + 1)) as k from cut2))"""
_MARKED = rf"""{_LINES},
h0 as (
  select *,
    case when length(line) between 1 and 100 and len(regexp_split_to_array(line, '\s+')) <= 8 and length(line) - length(replace(line, '.', '')) <= 1
      then {_CANON}[lower(regexp_extract(line, {_q(_HEADING)}, 1, 'i'))] end as own,
    case when length(line) > 45 then {_CANON}[lower(regexp_extract(line, {_q('^' + RUN_ON + '$')}, 1, 'i'))] end as begun,
    regexp_extract(line, {_q('^' + RUN_ON + '$')}, 2, 'i') as rest
  from lines),
marked as (
  select paper_id, page_number, line_no, line, coalesce(own, begun) as heading,
    case when own is not null or line = '' then null when begun is not null then rest else line end as body
  from h0)"""
_PARAS = rf"""{_MARKED},
placed as (
  select *, sum(case when heading is not null or line = '' then 1 else 0 end) over w as grp, last_value(heading ignore nulls) over w as sec,
    bool_or(heading is not null) over (partition by paper_id) as seen
  from marked window w as (partition by paper_id order by page_number, line_no rows between unbounded preceding and current row)),
grouped as (
  select paper_id, grp, first(sec) as sec, first(seen) as seen, min(page_number) as page_number,
    {_strip(r"regexp_replace(string_agg(body, ' ' order by page_number, line_no), '[ \t]+', ' ', 'g')")} as text
  from placed where body is not null group by paper_id, grp),
numbered as (
  select *, coalesce(sec, case when seen then 'Preamble' else 'Introduction' end) as section, row_number() over (partition by paper_id order by grp)::int as para_no
  from grouped where length(text) >= 2),
paras as (
  select paper_id, {_ORD} as section_ord, section, para_no, 'p' || para_no as paragraph_id, page_number::int as page_number, {_latex('text')} as text
  from numbered)"""
_SETS = "sets as (select doc_id // 10 as set_id, doc_id % 10 as paper_ord, 'd' || doc_id as paper_id from documents)"
_SCORES = ", ".join("(" + " + ".join(f"regexp_matches(statement, {_q(p)}, 'i')::int" for p in ps) + f") as {c}" for c, ps in GAPS.items())
_TOP = f"greatest({', '.join(GAPS)})"
_GAPS = f"""{_PARAS},
sents as (
  select paper_id, section_ord, para_no, paragraph_id, tag, k - 1 as sent_no, s[k] as statement
  from (select *, unnest(range(1, len(s) + 1)) as k from (
    select *, {_TAG} as tag, {_sentences('text')} as s from paras where section in ('Discussion', 'Limitations', 'Future Work')))),
scored as (select *, {_SCORES} from sents where length(statement) >= 20),
found as (
  select paper_id, section_ord, para_no, sent_no, paragraph_id, statement, tag,
    case when {_TOP} = 0 then 'methodological_blinds' {' '.join(f"when {c} = {_TOP} then {_q(c)}" for c in GAPS)} end as category
  from scored),
{_SETS},
once as (
  select * from (select *, row_number() over (partition by set_id, lower(statement) order by paper_ord, section_ord, para_no, sent_no) as r
    from found join sets using (paper_id)) where r = 1),
gaps as (
  select set_id, category, ord, paper_ord, paper_id, statement, tag as sources
  from (select *, row_number() over (partition by set_id, category order by paper_ord, section_ord, para_no, sent_no)::int as ord from once) where ord <= 12)"""
_CROSS = f"""{_GAPS},
tg as (
  select *, unnest(list_filter({_list(THEMES)}, lambda t: contains(lower(statement), t))) as theme,
    list_position(['failure_modes', 'dataset_shortfalls', 'methodological_blinds'], category) * 100 + ord as place
  from gaps),
pp as (select * from (select *, row_number() over (partition by set_id, theme, paper_id order by place) as r from tg) where r = 1),
sr as (
  select set_id, theme, string_agg(sources, ';' order by place) as sources
  from (select *, row_number() over (partition by set_id, theme order by place) as r from tg) where r <= 8 group by set_id, theme),
th as (
  select set_id, theme, min(place) as f, min_by(category, place) as category, string_agg(paper_id, ',' order by paper_id) as paper_ids, count(*) as n,
    string_agg(substr(statement, 1, 120), '; ' order by place) as said
  from pp group by set_id, theme having count(*) >= 2),
crossing as (
  select * from (select set_id, row_number() over (partition by set_id order by f, list_position({_list(THEMES)}, theme))::int as ord, theme, category, paper_ids, n,
    'Recurring theme: ''' || theme || '''. ' || n || ' papers: ' || said as statement from th) where ord <= 10)"""

_HITS = " union all ".join(
    f"select paper_id, section_ord, para_no, {i} as pattern, paragraph_id, page_number, section, {_q(n)} as name, regexp_extract(text, {_re2(p)[0]}, 1, {_re2(p)[1]}) as value from paras"
    for i, (n, p) in enumerate(HYPERPARAMETERS.items())
)
_HP = rf"""{_PARAS},
hits as ({_HITS}),
hp as (
  select paper_id, row_number() over (partition by paper_id order by section_ord, para_no, pattern)::int as ord, name,
    regexp_replace(trim(value), '[.,;]+$', '') as value, paragraph_id, page_number, {_TAG} as sources
  from (select *, row_number() over (partition by paper_id, name order by section_ord, para_no) as r from hits where value <> '') where r = 1)"""
_KNOWN = " union all ".join(
    f"select paper_id, section_ord, section, para_no, paragraph_id, page_number, text, {i} as place, {_q(n)} as name, '' as said from paras where regexp_matches(text, {_q(chr(92) + 'b' + n + chr(92) + 'b')})"
    for i, n in enumerate(DATASETS)
)
_DATA = rf"""{_PARAS},
dhits as ({_KNOWN} union all
  select paper_id, section_ord, section, para_no, paragraph_id, page_number, text, 99 + k as place, m[k] as name, s[k] as said
  from (select *, unnest(range(1, len(m) + 1)) as k from (
    select *, regexp_extract_all(text, {_q(DATASET_SHAPE)}, 1) as m, regexp_extract_all(text, {_q(DATASET_SHAPE)}, 0) as s from paras))),
ds as (
  select paper_id, row_number() over (partition by paper_id order by section_ord, para_no, place)::int as ord, name,
    case when said = '' then substr({_LEAD}, 1, 300) else said || ': ' || substr({_LEAD}, 1, 200) end as details, paragraph_id, {_TAG} as sources
  from (select *, row_number() over (partition by paper_id, lower(name) order by section_ord, para_no, place) as r from dhits) where r = 1)"""
_METRIC = _q(r"\b(" + "|".join(METRICS) + r")\b")
_PAIR = lambda k: f"try_cast(nullif(regexp_extract(text, {_q(SCORES)}, {k}, 'i'), '') as double)"
_BENCH = rf"""{_PARAS},
w as (
  select *, regexp_extract(text, {_METRIC}, 1, 'i') as word, regexp_extract_all(text, {_q(NUMBER)}) as nums,
    list_position(['Results', 'Abstract', 'Discussion', 'Introduction'], section)::int as scan
  from paras where section in ('Results', 'Abstract', 'Discussion', 'Introduction')),
c as (select *, {_PAIR(1)} as lo, {_PAIR(2)} as hi from w where word <> '' and len(nums) > 0),
n as (
  select paper_id, para_no, i, v,
    abs(instr(text, word) - instr(text, case when v = floor(v) and contains(text, v::bigint::varchar) then v::bigint::varchar else v::varchar end)) as far
  from (select *, nums[i]::double as v from (select *, unnest(range(1, len(nums) + 1)) as i from c))),
near as (select paper_id, para_no, v from (select *, row_number() over (partition by paper_id, para_no order by far, i) as r from n) where r = 1),
b as (
  select c.paper_id, scan, c.para_no, paragraph_id, page_number, section, substr({_LEAD}, 1, 200) as context,
    coalesce(nullif(regexp_extract(text, {_q(TASK)}, 1), ''), section || ' evaluation') as task,
    case when length(word) <= 4 then upper(word) else word end as metric, case when lo is not null then lo else 0 end::double as baseline,
    case when lo is not null then hi else v end as score, row_number() over (partition by c.paper_id, scan order by c.para_no) as r
  from c join near using (paper_id, para_no)),
m as (select paper_id, {', '.join(f'count(*) filter (where scan = {k}) as n{k}' for k in range(1, 5))} from b group by paper_id),
m1 as (select *, least(n1, 10) as k1 from m),
m2 as (select *, least(n2, greatest(10 - k1, 1)) as k2 from m1),
m3 as (select *, least(n3, greatest(10 - k1 - k2, 1)) as k3 from m2),
m4 as (select *, least(n4, greatest(10 - k1 - k2 - k3, 1)) as k4 from m3),
res as (
  select paper_id, row_number() over (partition by paper_id order by scan, para_no)::int as ord, task, metric, baseline, score, round(score - baseline, 6) as delta,
    lower(metric) not in ({', '.join(map(_q, LOWER_IS_BETTER))}) as higher_is_better, context, paragraph_id, page_number, section, {_TAG} as sources
  from b join m4 using (paper_id) where r <= case scan when 1 then k1 when 2 then k2 when 3 then k3 else k4 end)"""
_ARCH = rf"""{_PARAS},
arch as (
  select paper_id, {_LEAD} as architecture, paragraph_id, {_TAG} as sources
  from (select *, row_number() over (partition by paper_id order by (not regexp_matches(lower(text), {_q('|'.join(ARCHITECTURE))}))::int, (section <> 'Methodology')::int, para_no) as r
    from paras where section in ('Methodology', 'Abstract')) where r = 1)"""
_LEADS = f"""{_PARAS},
ls as (
  select paper_id, section_ord, section, para_no, tag, k, s[k] as s
  from (select *, unnest(range(1, len(s) + 1)) as k from (select *, {_TAG} as tag, {_sentences('text')} as s from paras))),
lr as (select * from (select *, row_number() over (partition by paper_id, section order by para_no, k) as r from ls) where r <= 2),
lb as (
  select *, coalesce(sum(length(s) + 1) over (partition by paper_id, section order by para_no range between unbounded preceding and 1 preceding), 0) - 1 as before from lr),
leads as (
  select paper_id, section_ord, section, string_agg(s, ' ' order by r) as text, string_agg(tag, ';' order by r) filter (where k = 1) as sources
  from lb where before <= 600 group by paper_id, section_ord, section),
ones as (select paper_id, section, {_LEAD} as text, {_TAG} as sources from (select *, row_number() over (partition by paper_id, section order by para_no) as r from paras) where r = 1),
openers as (select paper_id, section, {_TAG} as tag from (select *, row_number() over (partition by paper_id, section order by section_ord, para_no) as r from paras) where r = 1),
firsts as (select paper_id, {_TAG} as tag from (select *, row_number() over (partition by paper_id order by section_ord, para_no) as r from paras) where r = 1)"""
_WIDE = ", ".join(f"max({c}) filter (where section = {_q(x)}) as {c[0]}_{x.lower().replace(' ', '_')}" for x in SECTIONS for c in ("text", "sources"))
_BULLETS = f"""wide as (select paper_id, {_WIDE} from (select distinct paper_id from pages) left join ones using (paper_id) group by paper_id),
bullets as (
  select paper_id, 1 as bullet_no, coalesce(t_abstract, t_introduction, {_q(NO_TEXT[0])}) as text, coalesce(s_abstract, s_introduction, '') as sources from wide
  union all select paper_id, 2, coalesce(t_results, t_discussion, {_q(NO_TEXT[1])}), coalesce(s_results, s_discussion, '') from wide
  union all select paper_id, 3, coalesce(nullif(concat_ws(' ', t_limitations, t_future_work), ''), t_discussion, {_q(NO_TEXT[2])}),
    coalesce(nullif(concat_ws(';', s_limitations, s_future_work), ''), s_discussion, '') from wide)"""
_SUMMED = f"summed as (select paper_id, row_number() over (partition by paper_id order by list_position({_PRIORITY}, section))::int as ord, section, text, sources from leads where section not in ('Preamble', 'References'))"
_TITLES = r"""titles as (
  select paper_id, coalesce(t, replace(regexp_replace(filename, '\.[^.]*$', ''), '_', ' ')) as title
  from (select paper_id, min(filename) as filename from pages group by paper_id)
  left join (select paper_id, min_by(line, line_no) as t from lines where page_number = 1 and length(line) >= 15 group by paper_id) using (paper_id))"""
_TLDR = f"""{_TITLES},
tldrs as (
  select paper_id, ({_sentences("coalesce(o.text, title || '.')")})[1] as tldr, coalesce(sources, '') as sources
  from titles left join (select * from ones where section = 'Abstract') o using (paper_id))"""
_FONT = """sp as (
  select paper_id, line_no, line, case when line_no = substr(paper_id, 2)::bigint % 3 then 18 when line_no > 16 then 30 else 10 end as size
  from lines where page_number = 1 and line_no * 20 <= 320 and length(line) >= 10),
font as (select paper_id, line as title from (select *, row_number() over (partition by paper_id order by size desc, line_no) as r from sp) where r = 1)"""
_PEOPLE = rf"""pl as (select *, row_number() over (partition by paper_id order by line_no) as n from lines where page_number = 1 and line <> ''),
pa as (
  select pl.*, coalesce(min(case when contains(lower(line), lower(substr(title, 1, 25))) then n end) over (partition by paper_id), 1) as place from pl join titles using (paper_id)),
ps as (select *, min(case when contains(lower(line), 'abstract') and n > place then n end) over (partition by paper_id) as stop from pa),
pn as (
  select paper_id, n, list_filter(list_transform(regexp_split_to_array(line, ',|\band\b|;|·|\|'), lambda x: {_strip('x')}),
    lambda x: len(regexp_split_to_array(x, '\s+')) between 1 and 4 and length(x) >= 3 and not regexp_matches(x, {_re2(NO_NAME)[0]}, 'i')) as names
  from ps where n > place and n <= place + 4 and (stop is null or n < stop) and not regexp_matches(line, {_re2(AFFILIATION)[0]}, 'i') and length(line) < 200
    and not regexp_matches(line, '\d') and (regexp_matches(line, ',|\band\b', 'i') or len(regexp_split_to_array(line, '\s+')) between 2 and 4)),
people as (
  select paper_id, coalesce(names[:20], []) as authors
  from titles left join (select paper_id, min_by(names, n) as names from pn where len(names) > 0 group by paper_id) using (paper_id))"""
_YEARS = rf"""heads as (select paper_id, min(filename) as filename, string_agg(text, chr(10) order by page_number) as t from pages where page_number <= 2 group by paper_id),
stamps as (
  select *, regexp_extract(t, {_q(ARXIV)}, 1, 'i') as stamp,
    list_filter(list_transform(regexp_extract_all(t || chr(10) || filename, {_q(YEAR)}, 1), lambda v: v::int), lambda v: v between 1990 and 2100) as years
  from heads),
dated as (
  select paper_id, (case when stamp <> '' then left(stamp, 2)::int + case when left(stamp, 2)::int < 50 then 2000 else 1900 end else list_max(years) end)::int as year,
    nullif(regexp_extract(t, {_q(DOI)}, 1, 'i'), '') as doi
  from stamps)"""
_COUNTED = """counted as (
  select paper_id, filename, n as page_count, coalesce(m, 0) as paragraph_count
  from (select paper_id, min(filename) as filename, count(*) as n from pages group by paper_id)
  left join (select paper_id, count(*) as m from paras group by paper_id) using (paper_id))"""
_SECTIONED = f"""sectioned as (
  select paper_id, section_ord, section, coalesce(n, 0) as n_paragraphs, coalesce(t, '') as text
  from (select distinct paper_id, section, {_ORD} as section_ord from pages, (select unnest({_list(SECTIONS[1:8])}) as section))
  full join (select paper_id, section, section_ord, count(*) as n, string_agg(text, chr(10) || chr(10) order by para_no) as t from paras group by paper_id, section, section_ord)
  using (paper_id, section, section_ord))"""

# search: every twentieth document asks

_POST = f"""post as (select doc_id as id, len(t) as size, unnest(t) as term from (select doc_id, {_tokens("coalesce(text, '')")} as t from documents)),
p as (select id, term, count(*) as tf, first(size) as size from post group by id, term),
st as (select count(*) as n, avg(len({_tokens("coalesce(text, '')")})) as mean from documents)"""
_ASKED = "asked as (select doc_id as query_id, text from documents where doc_id % 20 = 0 and trim(coalesce(text, '')) <> '')"
_ODD = """asked as (select * from (
  select doc_id as query_id, case doc_id % 80 when 0 then '  ' when 20 then '?!' when 40 then 'zzyzx' || doc_id else 'qqxw ' || substr(text, 1, 40) end as text
  from documents where doc_id % 20 = 0) where trim(coalesce(text, '')) <> '')"""
_BM25 = f"""q as (select query_id, term, count(*) as times from (select query_id, unnest({_tokens('text')}) as term from asked) group by query_id, term),
df as (select term, count(*) as df from p group by term),
bm as (
  select query_id, id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) as bm25
  from p join q using (term) join df using (term), st group by query_id, id)"""


def _vectors(source: str, key: str, name: str) -> str:
    return f"""{name}c as (
  select {key} as id, ('0x' || right(md5(term), 2))::int as bucket, count(*) as n
  from (select {key}, unnest({_tokens("coalesce(text, '')")}) as term from {source}) group by 1, 2),
{name} as (select id, bucket, n / sqrt(sum(n * n) over (partition by id)) as weight from {name}c)"""


_HASHED = f"""{_vectors("documents", "doc_id", "v")}, {_vectors("asked", "query_id", "u")},
dots as (select u.id as query_id, v.id as id, sum(v.weight * u.weight) as dense from v join u using (bucket) group by 1, 2)"""
_GIVEN = """dots as (
  select q.vec_id as query_id, x.vec_id as id, list_inner_product(q.embedding::double[], x.embedding::double[])
    / sqrt(list_inner_product(q.embedding::double[], q.embedding::double[]) * list_inner_product(x.embedding::double[], x.embedding::double[])) as dense
  from embeddings q, embeddings x where q.vec_id % 20 = 0)"""


def _hybrid(top_k: int, dots: str = _HASHED) -> tuple[str, str]:
    pool = max(2 * top_k, 10)
    return f"""{_BM25}, {dots},
cs as (select query_id, id, coalesce(dense, 0) as dense from (select query_id, doc_id as id from asked, documents) left join dots using (query_id, id)),
votes as (
  select query_id, id, 0.6 / (60 + place) as vote, dense as d
  from (select *, row_number() over (partition by query_id order by round(dense, 9) desc, id) as place from cs) where place <= {pool}
  union all select query_id, id, 0.4 / (60 + place), null
  from (select *, row_number() over (partition by query_id order by round(bm25, 9) desc, id) as place from bm where bm25 > 0) where place <= {pool}),
fused as (select query_id, id, sum(vote) as score, coalesce(max(d), 0) as d from votes group by query_id, id)""", f"""
select query_id, rank, id, round(score, 6) as score, round(d, 6) as dense_score, round(coalesce(bm25, 0), 6) as bm25_score
from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from fused) left join bm using (query_id, id) where rank <= {top_k}"""


_SCOPED = f"""{_POST.split(',' + chr(10) + 'st as')[0]}, {_ASKED},
q as (select query_id, term, count(*) as times from (select query_id, unnest({_tokens('text')}) as term from asked) group by query_id, term),
sc as (select query_id, d.doc_id as id from asked a join documents o on o.doc_id = a.query_id join documents d on d.source = o.source),
st as (
  select query_id, count(*) as n, avg(len(t)) as mean
  from sc join (select doc_id as id, {_tokens("coalesce(text, '')")} as t from documents) using (id) group by query_id),
hit as (select query_id, id, term, tf, size, times from p join sc using (id) join q using (query_id, term)),
df as (select query_id, term, count(*) as df from hit group by query_id, term),
bm as (
  select query_id, id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) as b
  from hit join df using (query_id, term) join st using (query_id) group by query_id, id),
{_vectors("documents", "doc_id", "v")}, {_vectors("asked", "query_id", "u")},
cs as (select sc.query_id, sc.id, sum(v.weight * u.weight) as d from sc join v on v.id = sc.id join u on u.id = sc.query_id and u.bucket = v.bucket group by 1, 2),
bo as (select query_id, id, coalesce(d, 0) as d, coalesce(b, 0) as b from sc left join cs using (query_id, id) left join bm using (query_id, id)),
pl as (
  select *, row_number() over (partition by query_id order by round(d, 9) desc, id) as rd, row_number() over (partition by query_id order by round(b, 9) desc, id) as rb from bo),
fu as (select *, case when rd <= 10 then 0.6 / (60 + rd) else 0 end + case when b > 0 and rb <= 10 then 0.4 / (60 + rb) else 0 end as score from pl)"""

_CUT = rf"string_split(regexp_replace(p.t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_CHUNKS = rf"""{_PARAS},
pl as (
  select paper_id, list({{'section': section, 'id': paragraph_id, 'page': page_number, 't': text}} order by section_ord, para_no) as ps
  from paras where trim(text) <> '' group by paper_id),
pt as (
  select *, list_transform(ps, lambda p: length(p.t)) as ls,
    list_transform(ps, lambda p: case when length(p.t) > 2000
      then list_reduce({_CUT}, lambda b, s: case when length(b) > 0 and length(b) + length(s) > 1000 then s else trim(b || ' ' || s) end) else p.t end) as tails,
    -- the parts of a long paragraph, the last of them growing, set apart as in a chunk of its own
    list_transform(ps, lambda p: case when length(p.t) > 2000 then replace(
      list_reduce({_CUT}, lambda b, s: case when length(string_split(b, chr(1))[-1]) > 0 and length(string_split(b, chr(1))[-1]) + length(s) > 1000 then b || chr(1) || s else trim(b || ' ' || s) end),
      chr(1), chr(10) || chr(10)) else p.t end) as wholes
  from pl),
pc as (select *, len(ps) as np, list_transform(range(0, len(ls) + 1), lambda i: coalesce(list_sum(ls[1:i]), 0)) as cs from pt),
ch as (
  select paper_id, 0 as n, -1::bigint as c, false as part, 0::bigint as a, coalesce(list_min(list_filter(range(0, np + 1), lambda j: cs[j + 1] >= 1000)), np)::bigint as z from pc
  union all
  select paper_id, n + 1, nc, split, z, coalesce(list_min(list_filter(range(z, np + 1), lambda j: held + cs[j + 1] - cs[z + 1] >= 1000)), np)::bigint
  from (select *, case when nc < 0 then 0 when split then length(tails[z]) else ls[z] end as held from (
    select ch.paper_id, n, z, np, cs, ls, tails, case when z > a then z - 1 else -1 end as nc, c < 0 and z = a + 1 and ls[z] > 2000 as split
    from ch join pc on ch.paper_id = pc.paper_id where z < np))),
ck as (
  select ch.*, ps, tails, wholes, case when c < 0 then [] else [ps[c + 1]] end || ps[a + 1:z] as items,
    case when c < 0 then '' when part then tails[c + 1] else ps[c + 1].t end as said from ch join pc on ch.paper_id = pc.paper_id)"""

_HEAD = "'TITLE: ' || title || chr(10) || 'AUTHORS: ' || coalesce(array_to_string(authors, ', '), '') || chr(10) || 'YEAR: ' || coalesce(year::varchar, 'None') || chr(10) || chr(10)"


def _contexts(budget: int) -> tuple[str, str]:
    return f"""{_PARAS}, {_TITLES}, {_PEOPLE}, {_YEARS},
md as (
  select paper_id, section, string_agg('[' || paragraph_id || '|p.' || page_number || '] ' || text, chr(10) order by para_no) as body from paras group by paper_id, section),
al as (select distinct paper_id, section from pages, (select unnest({_PRIORITY}[:7]) as section)),
hd as (select paper_id, {_HEAD} as head from titles join people using (paper_id) join dated using (paper_id)),
bl as (
  select paper_id, '## ' || section || coalesce(chr(10) || body, '') || chr(10) || chr(10) as block, list_position({_PRIORITY}, section) as ord
  from al full join md using (paper_id, section)),
us as (select *, length(head) + sum(length(block)) over (partition by paper_id order by ord) as used from bl join hd using (paper_id)),
la as (select *, min(case when used > {budget} then ord end) over (partition by paper_id) as last, {budget} - (used - length(block)) as room from us),
pt as (
  select paper_id, head, ord, case when last is null or ord < last then block when ord = last and room > 200 and ord <= 3
    then substr(block, 1, room::int) || chr(10) || '[truncated]' || chr(10) || chr(10) else '' end as part from la),
cx as (select paper_id, head || string_agg(part, '' order by ord) as context from pt group by paper_id, head)""", "select paper_id, length(context)::int as n_chars, md5(context) as digest from cx"


_SPANS = f"list_filter(list_transform(regexp_extract_all(text, {_q(MATH_SPAN)}, 0, 's'), lambda s: trim(s)), lambda s: length(s) >= 4)"
_LOSSES = f"""{_PARAS},
rd as (select *, {_SPANS} as spans, list_position(['Methodology', 'Abstract', 'Introduction'], section) as rank from paras where section in ('Methodology', 'Abstract', 'Introduction')),
rw as (
  select *, min(case when len(spans) > 0 then rank end) over (partition by paper_id) as f, min(case when len(spans) > 0 then para_no end) over (partition by paper_id, rank) as y,
    min(para_no) over (partition by paper_id, rank) as o from rd),
ex as (select *, spans[k] as expression from (select *, unnest(range(1, len(spans) + 1)) as k from rw where (rank = f and para_no = y) or (rank > f and para_no = o))),
oc as (select * from (select *, row_number() over (partition by paper_id, expression order by rank, k) as r from ex) where r = 1),
losses as (
  select paper_id, row_number() over (partition by paper_id order by rank, k)::int as ord, expression,
    substr(coalesce(list_filter({_sentences('text')}, lambda x: contains(x, substr(expression, 1, 20)))[1], {_LEAD}), 1, 300) as description, paragraph_id, {_TAG} as sources
  from oc)"""
_HARD = f"""{_PARAS}, hw as (select *, regexp_extract(text, {_re2(HARDWARE)[0]}, 1, 'i') as hardware from paras),
hard as (
  select paper_id, hardware, paragraph_id, page_number, {_TAG} as sources
  from (select *, row_number() over (partition by paper_id order by section_ord, para_no) as r from hw where hardware <> '') where r = 1)"""
_ROWS = f"""{_BENCH}, {_SETS},
keyed as (select *, {_KEY.format('task')} as task_key, {_KEY.format('metric')} as metric_key from res join sets using (paper_id)),
lasts as (
  select set_id, task_key, metric_key, paper_ord, paper_id, min(ord) as seen, max_by(delta, ord) as delta, max_by(baseline, ord) as baseline, max_by(score, ord) as score,
    max_by(metric, ord) as own, max_by(sources, ord) as sources, max_by(task, ord) as task, max_by(metric, ord) as metric, max(ord) as ord
  from keyed group by 1, 2, 3, 4, 5),
brows as (
  select set_id, row_number() over (partition by set_id order by f, task_key || ' ' || metric_key)::int as row_ord, task_key, metric_key, task, metric, n_papers, verdict,
    case verdict when 'contradiction' then 'Conflicting ' || metric || ' results on ' || task || ': ' || said || '.'
      when 'consensus' then 'Consistent direction on ' || task || ' [' || metric || '] across papers.' else '' end as note, paper_ids, sources
  from (select set_id, task_key, metric_key, count(*)::int as n_papers, min(paper_ord * 1000 + seen) as f, max_by(task, paper_ord * 1000 + ord) as task,
      max_by(metric, paper_ord * 1000 + ord) as metric, string_agg(paper_id || ' Δ' || printf('%+.4g', delta), ', ' order by paper_ord) as said,
      case when count(*) < 2 then 'single-source' when bool_or(delta > 0) and bool_or(delta < 0) then 'contradiction' else 'consensus' end as verdict,
      string_agg(paper_id, ',' order by paper_id) as paper_ids, array_to_string((list(sources order by paper_ord))[:8], ';') as sources
    from lasts group by 1, 2, 3))"""
_CELL = "printf('%g → %g (Δ%+.4g %s)', baseline, score, delta, metric)"
_DROWS = """dplaced as (select set_id, paper_ord, paper_id, ord, name, substr(details, 1, 200) as v, sources from sets join ds using (paper_id)),
drows as (
  select set_id, row_number() over (partition by set_id order by f, name)::int as row_ord, name, paper_ids, case when n >= 2 then 'consensus' else 'single-source' end as verdict,
    case when n >= 2 then 'Shared evaluation on ' || name || '.' else '' end as note, sources
  from (select set_id, name, min(paper_ord * 1000 + ord) as f, count(*) as n, string_agg(paper_id, ',' order by paper_id) as paper_ids,
    array_to_string((list(sources order by paper_ord))[:6], ';') as sources from dplaced group by set_id, name))"""


def _with(ctes: str, select: str) -> str:
    return f"(with {ctes} {select})"


_MAIN: dict[str, tuple[str, str]] = {
    "a1_intake": (
        """f as (
  select doc_id, 'd' || doc_id || case when doc_id % 9 = 4 then '.txt' when doc_id % 9 = 5 then '.PDF' else '.pdf' end as path,
    (case when doc_id % 7 = 0 then 0 when doc_id % 7 = 1 then 52428800 + n_chars else n_chars end)::bigint as length, doc_id % 10 = 7 as other,
    case when doc_id % 5 = 0 then coalesce(substr(text, 1, 8), '') else '%PDF-1.4' end as content from documents),
j as (
  select path, length, case when not ends_with(lower(path), '.pdf') then 'name is not .pdf' when other then 'unsupported content type' when length > 52428800 then 'larger than 50 MiB'
    when length = 0 then 'empty' when left(content, 4) <> '%PDF' then 'not a PDF' when doc_id % 11 = 3 then 'no pages' when doc_id % 11 = 5 then 'no text' end as reason from f)""",
        "select path, length, case when reason is null then 201 when reason in ('name is not .pdf', 'unsupported content type') then 400 when reason = 'larger than 50 MiB' then 413 else 422 end as status, reason from j",
    ),
    "a2_page_text": (_PAGES, "select * from pages"),
    "a2_read_pages": (
        f"{_PAGES}, x as (select *, substr(paper_id, 2)::bigint % 9 as k from pages)",
        """select case k when 1 then 'not of the model''s shape' when 2 then 'page_number: below 1' when 3 then 'paper_id: missing' when 5 then 'not of the model''s shape' when 7 then 'paper_id: empty' end as refused,
  case when k = 7 then ' ' when k not in (1, 3, 5) then paper_id end as paper_id, case when k not in (1, 5) then filename end as filename,
  case when k = 2 then 0 when k not in (1, 5) then page_number end as page_number, md5(case when k in (1, 4, 5) then '' else text end) as digest, count(*) as n from x group by all""",
    ),
    "a3_nested_papers": (_PARAS, "select paper_id, section_ord, section, para_no, paragraph_id, page_number, text from paras"),
    "a4_upsert": (
        f"{_PAGES}, tox as (select 'd' || doc_id as paper_id from labels where toxic = 1)",
        "select paper_id || ':' || page_number as chunk_id, paper_id, md5(case when page_number >= 2 and paper_id in (select paper_id from tox) then upper(text) else text end) as digest from pages",
    ),
    "a4_upsert_counts": (_PAGES, "select paper_id, count(*) as n from pages where page_number >= 2 and paper_id in (select 'd' || doc_id from labels where toxic = 1) group by paper_id"),
    "a5_delete_papers": (
        f"{_PAGES}, tox as (select distinct 'd' || doc_id as paper_id from labels where toxic = 1)",
        """select paper_id, count(*) as n_pages, 0::bigint as removed from pages where paper_id not in (select paper_id from tox) group by paper_id
union all select tox.paper_id, 0, count(pages.paper_id) from tox left join pages using (paper_id) group by tox.paper_id""",
    ),
    "a6_list_papers": (
        f"{_PARAS}, {_TITLES}, {_YEARS}, {_COUNTED}",
        "select paper_id, filename, title, year, page_count, paragraph_count from counted left join titles using (paper_id) left join dated using (paper_id)",
    ),
    "a7_lookup": (f"{_PARAS}, {_SECTIONED}", "select paper_id, section, text from sectioned where lower(section) = 'results'"),
    "a7_papers": (
        f"{_PARAS}, {_COUNTED}, asked as (select doc_id as request_id, 'd' || (doc_id + quality * 3) as paper_id from labels)",
        "select request_id, paper_id, filename, page_count, paragraph_count, filename is not null as found from asked left join counted using (paper_id)",
    ),
    "a8_resolve": (
        "asked as (select doc_id // 10 as request_id, -doc_id as ord, 'd' || (doc_id + quality * 3) as paper_id, exists(select 1 from documents d where d.doc_id = labels.doc_id + quality * 3) as there from labels)",
        """select request_id, coalesce(string_agg(paper_id, ',' order by ord) filter (where there), '') as papers, coalesce(string_agg(paper_id, ',' order by ord) filter (where not there), '') as missing,
  coalesce('Papers not found: ' || string_agg(paper_id, ', ' order by ord) filter (where not there), '') as message from asked group by request_id""",
    ),
    "a9_reuse": (
        f"{_LEADS}, {_TLDR}, x as (select *, substr(paper_id, 2)::bigint as k from tldrs)",
        """select paper_id, case when k % 2 = 0 and k % 8 <> 0 and k % 12 <> 2 then 'openai-structured' else 'heuristic-fallback' end as source, 3 as n_bullets,
  case when k % 2 = 0 and k % 8 <> 0 and k % 12 <> 2 then 'stored' else tldr end as tldr from x""",
    ),
    "b1_lines": (_LINES, "select paper_id, page_number, count(*) as n_lines, sum((line = '')::int)::bigint as n_blank, sum(length(line))::bigint as n_chars from lines group by paper_id, page_number"),
    "b2_b3_headings": (_MARKED, "select paper_id, page_number, line_no, heading, coalesce(body, '') as rest from marked where heading is not null"),
    "b5_b8_paragraphs": (_PARAS, "select * from paras"),
    "b9_sections": (f"{_PARAS}, {_SECTIONED}", "select * from sectioned"),
    "b10_flat_numbers": (_PARAS, "select paper_id, paragraph_id, row_number() over (partition by paper_id order by section_ord, para_no)::int as flat_no, page_number from paras"),
    "b11_math": ("x as (select doc_id, coalesce(text, '') || '  λ·x ≤ Σ' || chr(9) || 'y ' as t from documents)", f"select doc_id, {_latex('t')} as latex from x"),
    "b12_math_spans": (
        f"{_PARAS}, ms as (select paper_id, paragraph_id, regexp_extract_all(text || {_q(r' $$a_1 + b$$ and \(c\) or \[d = e\].')}, {_q(MATH_SPAN)}, 0, 's') as s from paras), me as (select *, unnest(range(1, len(s) + 1)) as k from ms)",
        r"""select paper_id, paragraph_id, k - 1 as span_no, s[k] as span, starts_with(s[k], '$$') or starts_with(s[k], '\[') as block,
  case when starts_with(s[k], '$') and not starts_with(s[k], '$$') then substr(s[k], 2, length(s[k]) - 2) else substr(s[k], 3, length(s[k]) - 4) end as body from me""",
    ),
    "b13_tokens": (f"""x as (select doc_id, {_tokens("coalesce(text, '')")} as t from documents)""", "select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct, md5(array_to_string(t, ' ')) as digest from x"),
    "b14_sentences": (_PARAS, f"select paper_id, paragraph_id, (k - 1)::int as sent_no, s[k] as sentence from (select *, unnest(range(1, len(s) + 1)) as k from (select paper_id, paragraph_id, {_sentences('text')} as s from paras))"),
    "b15_keys": (f"{_LINES}, {_TITLES}", f"select paper_id, {_KEY.format('min(filename)')} as key, {_KEY.format('any_value(title)')} as title_key from pages join titles using (paper_id) group by paper_id"),
    "c1_titles_by_font": (f"{_LINES}, {_FONT}", "select * from font"),
    "c1_c2_titles": (f"{_LINES}, {_TITLES}, {_FONT}", "select paper_id, case when substr(paper_id, 2)::bigint % 2 = 0 then coalesce(font.title, titles.title) else titles.title end as title from titles left join font using (paper_id)"),
    "c2_titles": (f"{_LINES}, {_TITLES}", "select * from titles"),
    "c3_authors": (f"{_LINES}, {_TITLES}, {_PEOPLE}", "select * from people"),
    "c4_c5_year_doi": (f"{_PAGES}, {_YEARS}", "select * from dated"),
    "c6_abstracts": (_PARAS, "select paper_id, substr(string_agg(text, chr(10) || chr(10) order by para_no), 1, 2000) as abstract from paras where section = 'Abstract' group by paper_id"),
    "c7_counts": (f"{_PARAS}, {_COUNTED}", "select paper_id, page_count, paragraph_count from counted"),
    "c8_enrichment": (
        rf"""{_LINES}, {_TITLES}, {_PEOPLE}, {_YEARS},
cat as (
  select doc_id, case doc_id % 7 when 1 then 'Study ' || doc_id || ' of Learned' when 2 then 'Study ' || doc_id || ' of Learned Sequence Models: An Extended Report' when 3 then 'Other work ' || doc_id
    when 4 then 'Study ' || doc_id || ' of Le' || repeat('x', 35) when 5 then 'Study ' || doc_id || ' of Lerned Sequence Models' else 'STUDY ' || doc_id || ' of learned sequence models' end as c
  from documents),
ck as (select *, {_KEY.format('c')} as ck, list_distinct(regexp_extract_all(lower(c), '\w+')) as cw from cat),
ts as (
  select substr(paper_id, 2)::bigint as paper, title, {_KEY.format('title')} as k, list_distinct(regexp_extract_all(lower(title), '\w+')) as tw, authors, year, doi
  from titles join people using (paper_id) join dated using (paper_id)),
-- words of entries weigh by rarity; the entries that share half the weight, the five best, and last the first one that matches
wt as (select w, ln(1 + (select count(*) from cat) / count(*)) as g from (select unnest(cw) as w from ck) group by w),
ew as (select doc_id, w, g, sum(g) over (partition by doc_id) as whole from (select doc_id, unnest(cw) as w from ck) join wt using (w)),
pw as (select paper, w, g, sum(g) over (partition by paper) as whole from (select paper, unnest(tw) as w from ts) join wt using (w)),
rs as (select paper, doc_id, round(sum(ew.g) / (any_value(ew.whole) + any_value(pw.whole) - sum(ew.g)), 9) as alike from pw join ew using (w) group by paper, doc_id),
five as (select *, row_number() over (partition by paper order by alike desc, doc_id) as r from rs where alike >= 0.5 qualify r <= 5),
cand as (
  select paper, doc_id, r from five
  union all select paper, min(doc_id), 6 from ts join ck on starts_with(ck, left(k, 40)) or starts_with(k, left(ck, 40)) group by paper),
ks as (
  select *, starts_with(ck, left(k, 40)) or starts_with(k, left(ck, 40)) as same from cand join ck using (doc_id) join ts using (paper)
  qualify row_number() over (partition by paper order by not same, r) = 1),
-- an entry that matches is alike in the whole shorter key; of the others the misspelt ones and the longer ones are alike enough
ok as (
  select ts.paper, ts.title, ts.authors, ts.year, ts.doi, doc_id, c, coalesce(
    case when same then 2.0 * least(length(ts.k), length(ck)) / (length(ts.k) + length(ck)) >= 0.6 else doc_id = ts.paper and doc_id % 7 in (2, 5) end, false) as hit
  from ts left join ks using (paper))""",
        """select 'd' || paper as paper_id, case when hit then c else title end as title, coalesce(year, case when hit then (doc_id % 30 + 1990)::int end) as year,
  case when hit and doc_id % 7 <> 6 then 'V' end as venue, coalesce(doi, case when hit then '10.1/' || doc_id end) as doi,
  case when hit and len(authors) <= 1 then 'A, B' else array_to_string(authors, ', ') end as authors, case when hit then 'catalog' else 'heuristic' end as enrichment_source from ok""",
    ),
    "d1_chunks": (
        "recursive " + _CHUNKS,
        f"""select paper_id || ':c' || n as chunk_id, paper_id, n as chunk_no, items[1].section as section, list_min(list_transform(items, lambda p: p.page)) as page_number,
  array_to_string(list_sort(list_distinct(list_transform(items, lambda p: p.page))), ',') as pages, array_to_string(list_transform(items, lambda p: p.id), ',') as paragraph_ids,
  len({_tokens("said || ' ' || array_to_string(list_transform(ps[a + 1:z], lambda p: p.t), ' ')")})::int as token_count,
  md5(array_to_string(case when c < 0 then [] when z = a and not part then [wholes[c + 1]] else [said] end || case when c < 0 and z = a + 1 then [wholes[z]] else list_transform(ps[a + 1:z], lambda p: p.t) end, chr(10) || chr(10))) as digest from ck""",
    ),
    "d3_hashed_vectors": (_vectors("documents", "doc_id", "v"), "select id, bucket, round(weight, 9) as weight from v"),
    "d4_term_statistics": (_POST, "select term, count(*) as df, sum(tf)::bigint as cf, any_value(st.n) as n, round(any_value(mean), 6) as mean from p, st group by term"),
    "d5_bm25": (f"{_POST}, {_ASKED}, {_BM25}", "select query_id, id, round(bm25, 6) as bm25 from (select *, row_number() over (partition by query_id order by round(bm25, 9) desc, id) as r from bm) where r <= 10"),
    "d7_dense_top_k": (
        "s as (select q.vec_id as query_id, x.vec_id as id, list_cosine_similarity(q.embedding::double[], x.embedding::double[]) as score from embeddings x, embeddings q where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from s)",
        "select query_id, rank, id, round(score, 6) as score from r where rank <= 10",
    ),
    "d9_hybrid_search": (f"{_POST}, {_ASKED}, {_hybrid(5)[0]}", _hybrid(5)[1]),
    "d9_given_vectors": (f"{_POST}, {_ASKED}, {_hybrid(5, _GIVEN)[0]}", _hybrid(5, _GIVEN)[1]),
    "d9_odd_queries": (f"{_POST}, {_ODD}, {_hybrid(20)[0]}", _hybrid(20)[1]),
    "d10_scoped_search": (
        _SCOPED,
        "select query_id, rank, id, round(score, 6) as score, round(case when rd <= 10 then d else 0 end, 6) as dense_score, round(b, 6) as bm25_score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from fu where score > 0) where rank <= 5",
    ),
    "d11_lexical_overlap": (
        f"{_POST}, {_ASKED}, q as (select distinct query_id, unnest({_tokens('text')}) as term from asked), s as (select query_id, id, count(*) as score from p join q using (term) group by query_id, id)",
        "select query_id, rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s) where rank <= 5",
    ),
    "e1_lead_sentences": (_LEADS, "select * from leads"),
    "e2_bullets": (f"{_LEADS}, {_BULLETS}", "select * from bullets"),
    "e3_section_summaries": (f"{_LEADS}, {_SUMMED}", "select * from summed"),
    "e4_tldr": (f"{_LEADS}, {_TLDR}", "select * from tldrs"),
    "e5_architectures": (_ARCH, "select * from arch"),
    "e6_hyperparameters": (_HP, "select * from hp"),
    "e7_losses": (_LOSSES, "select * from losses"),
    "e8_e9_datasets": (_DATA, "select * from ds"),
    "e10_hardware": (_HARD, "select * from hard"),
    "e11_e12_benchmarks": (_BENCH, "select * from res"),
    "e14_repair": (
        f"""{_LEADS},
tags as (select paper_id, para_no // 2 as claim_no, para_no, {_TAG} as tag, para_no % 3 <> 0 and (para_no // 2) % 4 <> 1 as good from paras),
cl as (select paper_id, claim_no, string_agg(tag, ';' order by para_no) filter (where good) as kept, case claim_no % 3 when 1 then 'Methodology' when 2 then 'Results' end as anchor from tags group by paper_id, claim_no)""",
        "select cl.paper_id, claim_no, anchor, coalesce(kept, openers.tag, firsts.tag) as sources from cl left join openers on openers.paper_id = cl.paper_id and openers.section = anchor join firsts on firsts.paper_id = cl.paper_id",
    ),
    "e15_audit": (
        f"""{_LEADS}, {_BULLETS}, {_SUMMED}, {_TLDR}, res as {_with(_BENCH, 'select * from res')},
ids as (select distinct paper_id, substr(paper_id, 2)::bigint as k from pages),
fb as (select paper_id, k, bullet_no, coalesce(nullif(sources, ''), tag, '') as sources from bullets join ids using (paper_id) left join firsts using (paper_id)),
issues as (
  select paper_id, 'executive[' || (bullet_no - 1) || ']: missing source tags' as issue from fb where not (k % 6 = 0 and bullet_no = 3) and (sources = '' or (k % 5 = 1 and bullet_no = 1))
  union all select paper_id, 'executive_summary must have exactly 3 bullets' from ids where k % 6 = 0
  union all select paper_id, 'technical_tldr empty' from ids where k % 9 = 4
  union all select paper_id, 'sectional[Results]: unknown tag ' || split_part(t, '|', 1) || '/p.' || (split_part(t, '|', 2)::int + 7)
    from (select paper_id, unnest(string_split(sources, ';')) as t from summed join ids using (paper_id) where k % 7 = 2 and section = 'Results'))""",
        "select paper_id, coalesce(string_agg(issue, '; ' order by issue), '') as issues, count(issue) = 0 as clean from ids left join issues using (paper_id) group by paper_id",
    ),
    "e16_contexts": _contexts(4000),
    "e16_whole_contexts": _contexts(15000),
    "f1_paper_refs": (f"{_LINES}, {_TITLES}, {_YEARS}, {_SETS}", "select set_id, paper_ord, paper_id, coalesce(nullif(title, ''), 'Untitled') as title, year from sets left join titles using (paper_id) left join dated using (paper_id)"),
    "f4_architecture_verdicts": (
        f"{_ARCH}, {_SETS}, v as (select set_id, n_values, case when n = 1 then 'single-source' when n_values = 0 then 'n/a' when n_values = 1 then 'consensus' else 'divergent' end as verdict from (select set_id, count(*) as n, count(distinct substr(architecture, 1, 300)) as n_values from sets left join arch using (paper_id) group by set_id))",
        "select *, case verdict when 'consensus' then 'Papers describe a matching architecture.' when 'divergent' then 'Papers use different architectures.' else '' end as note from v",
    ),
    "f5_hyperparameter_verdicts": (
        f"""{_HP}, {_SETS},
v as (
  select set_id, name, min(paper_ord * 1000 + ord) as f, count(*)::int as n_papers, count(distinct nullif(value, '')) as n_values, min(value) as value from hp join sets using (paper_id) group by set_id, name),
x as (select *, case when n_papers <= 1 then 'single-source' when n_values = 1 then 'consensus' else 'divergent' end as verdict from v)""",
        """select set_id, row_number() over (partition by set_id order by f, name)::int as row_ord, name, n_papers, n_values, verdict,
  case verdict when 'consensus' then 'All papers set ' || name || '=' || value || '.' when 'divergent' then name || ' differs across papers.' else '' end as note from x""",
    ),
    "f6_dataset_verdicts": (f"{_DATA}, {_SETS}, {_DROWS}", "select * from drows"),
    "f7_f8_benchmark_verdicts": (_ROWS, "select * from brows"),
    "f9_findings": (
        f"{_ROWS}, ds as {_with(_DATA, 'select * from ds')}, {_DROWS}",
        """select set_id, verdict as kind, 'dataset' as part, row_ord, 'Shared evaluation dataset: ' || name || '.' as statement, paper_ids, sources from drows where verdict = 'consensus'
union all select set_id, verdict, 'benchmark', row_ord, note, paper_ids, sources from brows where verdict <> 'single-source'""",
    ),
    "f10_cells": (_BENCH, f"select paper_id, ord, {_CELL} as cell from res"),
    "f11_wide_matrix": (f"{_HP}, {_SETS}", "select set_id, name as dimension, " + ", ".join(f"coalesce(nullif(min(value) filter (where paper_ord = {k}), ''), '—') as p{k}" for k in range(10)) + " from hp join sets using (paper_id) group by set_id, name"),
    "g1_g2_gap_sentences": (_GAPS, "select * from found"),
    "g3_g4_gaps": (_GAPS, "select * from gaps"),
    "g5_themes": (f"{_GAPS}, tagged as (select set_id, paper_id, unnest(list_filter({_list(THEMES)}, lambda t: contains(lower(statement), t))) as theme from gaps)", "select set_id, theme, count(distinct paper_id) as n_papers, count(*) as n_items from tagged group by set_id, theme having count(distinct paper_id) >= 2"),
    "g6_cross_cutting": (_CROSS, "select set_id, ord, theme, category, paper_ids, statement, sources from crossing join sr using (set_id, theme)"),
    "g7_counts": (
        _CROSS,
        """select set_id, category, coalesce(n, 0) as n, coalesce(papers, '') as papers
from (select distinct set_id from sets) cross join (select unnest(['failure_modes', 'dataset_shortfalls', 'methodological_blinds', 'cross_cutting']) as category) left join (
select set_id, category, count(*) as n, string_agg('1', ',') as papers from gaps group by set_id, category
union all select set_id, 'cross_cutting', count(*), string_agg(n::varchar, ',' order by ord) from crossing group by set_id) using (set_id, category)""",
    ),
    "g8_badges": (
        f"{_PARAS}, o as (select *, row_number() over (partition by paper_id, section order by page_number desc, para_no) as r from paras)",
        "select paper_id, section as claim_no, string_agg(paragraph_id || ' · p.' || page_number, ', ' order by r) filter (where r <= 4) as badges, greatest(count(*) - 4, 0)::int as more from o group by paper_id, section",
    ),
}

#: Parts of an envelope and the queries whose rows they hold.
PARTS = {"bullets": "e2_bullets", "sections": "e3_section_summaries", "tldr": "e4_tldr", "architecture": "e5_architectures", "hyperparameters": "e6_hyperparameters", "losses": "e7_losses", "datasets": "e8_e9_datasets", "hardware": "e10_hardware", "results": "e11_e12_benchmarks"}

PART_FIELDS = {
    "bullets": ["bullet_no", "text"], "sections": ["section", "text"], "tldr": ["tldr"], "architecture": ["architecture"], "hyperparameters": ["name", "value"],
    "losses": ["expression", "description"], "datasets": ["name", "details"], "hardware": ["hardware"], "results": ["task", "metric", "baseline", "score", "context"],
}


def _sub(name: str) -> str:
    return _with(*_MAIN[name])


_FIRST = _with(_LEADS, "select * from firsts")


def _part_lines(part: str, fields: list[str]) -> str:
    """A part's rows of a paper as one digest, with the paper's first source where one has none."""
    said = ", ".join(f"round({f} * 1000)::bigint::varchar" if f in ("baseline", "score") else f for f in fields)
    order = {"bullets": "bullet_no", "tldr": "tldr", "architecture": "architecture", "hardware": "hardware"}.get(part, "ord")
    line = f"concat_ws('|', {said}, coalesce(nullif(sources, ''), tag, ''))"
    return f"select paper_id, count(*)::int as n_{part}, md5(string_agg({line}, chr(10) order by {order})) as digest_{part} from x_{part} left join firsts using (paper_id) group by paper_id"


_MAIN["e13_envelope"] = (
    ", ".join(f"x_{n} as {_sub(q)}" for n, q in PARTS.items()) + f", firsts as {_FIRST}, " + ", ".join(f"c_{n} as ({_part_lines(n, f)})" for n, f in PART_FIELDS.items()),
    "select paper_id, 'heuristic-fallback' as source, "
    + ", ".join(f"coalesce(n_{n}, 0)::int as n_{n}, coalesce(digest_{n}, md5('')) as digest_{n}" for n in PARTS)
    + " from x_tldr "
    + " ".join(f"left join c_{n} using (paper_id)" for n in PARTS),
)
_MAIN["f2_f3_matrix"] = (
    f"""{_SETS}, firsts as {_FIRST}, brows as {_with(_ROWS, 'select * from brows')}, lasts as {_with(_ROWS, 'select * from lasts')},
vals as (
  select paper_id, 1 as rank, 1 as ord, 'tl_dr' as dimension, 'metadata' as kind, tldr as value, coalesce(nullif(sources, ''), tag, '') as sources from {_sub('e4_tldr')} left join firsts using (paper_id)
  union all select paper_id, 2, 1, 'architecture', 'methodology', substr(architecture, 1, 300), sources from {_sub('e5_architectures')}
  union all select paper_id, 3, ord, 'hyperparameter:' || name, 'methodology', value, sources from {_sub('e6_hyperparameters')}
  union all select paper_id, 4, ord, 'dataset:' || name, 'dataset', coalesce(nullif(substr(details, 1, 200), ''), 'evaluated'), sources from {_sub('e8_e9_datasets')}),
held as (
  select set_id, dimension, kind, paper_id, rank * 1000000 + paper_ord * 1000 + ord as place, value, sources from vals join sets using (paper_id)
  union all select set_id, 'benchmark:' || b.task || ' [' || b.metric || ']', 'benchmark', l.paper_id, 5000000 + row_ord * 1000, {_CELL.replace(', metric)', ', own)')}, l.sources
  from lasts l join brows b using (set_id, task_key, metric_key)),
given as (select set_id, dimension, kind, paper_id, min(place) as place, min_by(value, place) as value, min_by(sources, place) as sources from held group by 1, 2, 3, 4),
rws as (select set_id, dimension, kind, row_number() over (partition by set_id order by min(place), dimension)::int as row_ord from given group by 1, 2, 3)""",
    "select set_id, row_ord, dimension, kind, sets.paper_ord, paper_id, coalesce(nullif(value, ''), '—') as value, coalesce(sources, '') as sources from rws join sets using (set_id) left join given using (set_id, dimension, kind, paper_id)",
)
_MAIN["a3_papers"] = (
    f"{_PARAS}, {_TITLES}, {_PEOPLE}, {_YEARS}",
    f"""select paper_id, filename, page_count, paragraph_count, sections, digest,
  concat_ws('|', title, array_to_string(authors, ','), year::varchar, doi, 'pdf-heuristic', md5(abstract)) as metadata
from (select paper_id, min(filename) as filename, count(*)::int as page_count from pages group by paper_id)
left join (select paper_id, count(*)::int as paragraph_count from paras group by paper_id) using (paper_id)
left join (
  select paper_id, string_agg(section || '=' || n, ';' order by o) as sections, md5(string_agg(section || '|' || coalesce(t, ''), chr(10) order by o)) as digest, nullif(substr(trim(max(t) filter (where section = 'Abstract')), 1, 2000), '') as abstract
  from (select paper_id, section, o, coalesce(n, 0) as n, t from (select distinct paper_id from pages) cross join (select unnest({_list(SECTIONS)}) as section, unnest(range(9)) as o)
    left join (select paper_id, section, count(*) as n, string_agg(text, chr(10) || chr(10) order by para_no) as t from paras group by paper_id, section) using (paper_id, section))
  where n > 0 or o between 1 and 7 group by paper_id) using (paper_id)
left join titles using (paper_id) left join people using (paper_id) left join dated using (paper_id)""",
)
_MAIN["a3_refused"] = (
    "bad as (select case doc_id % 9 when 0 then 'good' when 2 then 'summary.executive_summary.sources.page_number: below 1' when 3 then 'extraction_source: unknown' "
    "when 4 then 'summary.executive_summary: not 3 entries' when 5 then 'summary.technical_tldr: missing' when 7 then 'paper_id: missing' else 'not of the model''s shape' end as refused, doc_id from documents)",
    "select refused, count(*) as n, count(distinct doc_id) filter (where refused not like '%shape' and refused not like 'paper_id%') as n_papers from bad group by refused",
)


def _lines(part: str, *fields: str) -> str:
    line = f"concat_ws('|', {', '.join(fields)}, coalesce(nullif(sources, ''), tag, ''))"
    order = "bullet_no" if part == "bullets" else "ord"
    return f"select paper_id, md5(string_agg({line}, chr(10) order by {order})) as {part} from x_{part} left join firsts using (paper_id) group by paper_id"


_EXTRACTED = {
    "bullets": _lines("bullets", "text"), "sections": _lines("sections", "section", "text"), "hyperparameters": _lines("hyperparameters", "name", "value"), "losses": _lines("losses", "expression", "description"),
    "datasets": _lines("datasets", "name", "details"), "results": _lines("results", "task", "metric", "context"),
}
_MAIN["e13_extractions"] = (
    ", ".join(f"x_{n} as {_sub(q)}" for n, q in PARTS.items()) + f", firsts as {_FIRST}, " + ", ".join(f"l_{n} as ({q})" for n, q in _EXTRACTED.items()),
    "select paper_id, 'heuristic-fallback' as extraction_source, tldr || '|' || coalesce(nullif(t.sources, ''), tag, '') as tldr, "
    "coalesce(architecture, '') || '|' || coalesce(a.sources, '') as architecture, coalesce(hardware, '') || '|' || coalesce(h.sources, '') as hardware, "
    + ", ".join(f"coalesce({n}, md5('')) as {n}" for n in _EXTRACTED)
    + ", coalesce(deltas, 0) as deltas from x_tldr t left join firsts using (paper_id) left join x_architecture a using (paper_id) left join x_hardware h using (paper_id) "
    + "left join (select paper_id, round(sum(delta), 6) as deltas from x_results group by paper_id) using (paper_id) "
    + " ".join(f"left join l_{n} using (paper_id)" for n in _EXTRACTED),
)
_MAIN["f2_f9_comparisons"] = (
    f"""cl as {_sub('f2_f3_matrix')}, vd as (
  select set_id, 'tl_dr' as dimension, 'n/a' as verdict, '' as note from cl where dimension = 'tl_dr' group by set_id
  union all select set_id, 'architecture', verdict, note from {_sub('f4_architecture_verdicts')}
  union all select set_id, 'hyperparameter:' || name, verdict, note from {_sub('f5_hyperparameter_verdicts')}
  union all select set_id, 'dataset:' || name, verdict, note from {_sub('f6_dataset_verdicts')}
  union all select set_id, 'benchmark:' || task || ' [' || metric || ']', verdict, note from {_sub('f7_f8_benchmark_verdicts')}),
rows_ as (select set_id, row_ord, concat_ws('|', dimension, kind, any_value(verdict), any_value(note), string_agg(concat_ws('|', paper_id, value, sources), '/' order by paper_ord)) as line
  from cl join vd using (set_id, dimension) group by set_id, row_ord, dimension, kind),
said as (select set_id, kind, string_agg(concat_ws('|', statement, paper_ids, sources), chr(10) order by part = 'benchmark', row_ord) as said from {_sub('f9_findings')} group by set_id, kind),
refs as (select set_id, string_agg(paper_id, ',' order by paper_ord) as paper_ids, string_agg(concat_ws('|', title, year::varchar), chr(10) order by paper_ord) as papers from {_sub('f1_paper_refs')} group by set_id)""",
    """select paper_ids, papers, n_rows, rows_digest, coalesce(a.said, '') as consensus, coalesce(b.said, '') as contradictions, 'heuristic' as generated_by
from refs left join (select set_id, count(*)::int as n_rows, md5(string_agg(line, chr(10) order by row_ord)) as rows_digest from rows_ group by set_id) using (set_id)
left join (select * from said where kind = 'consensus') a using (set_id) left join (select * from said where kind = 'contradiction') b using (set_id)""",
)
_MAIN["g_research_gaps"] = (
    f"""it as (
  select set_id, category as bucket, ord, concat_ws('|', category, paper_id, statement, sources) as line from {_sub('g3_g4_gaps')}
  union all select set_id, 'cross_cutting', ord, concat_ws('|', category, paper_ids, statement, sources) from {_sub('g6_cross_cutting')}), {_SETS}""",
    "select papers, "
    + ", ".join(f"coalesce(string_agg(line, chr(10) order by ord) filter (where bucket = '{b}'), '') as {b}" for b in [*GAPS, "cross_cutting"])
    + ", 'heuristic' as generated_by from (select set_id, string_agg(paper_id, ',' order by paper_ord) as papers from sets group by set_id) left join it using (set_id) group by set_id, papers",
)
# an index after a series of writes: what each left behind
_KEPT = """kept as (
  select doc_id, case when doc_id % 30 = 3 then text when doc_id % 10 = 3 then 'revised ' || coalesce(substr(text, 1, 200), '') || ' edition' || (doc_id % 7) else text end as text
  from documents where doc_id % 30 = 3 or doc_id not in (select doc_id from labels where toxic = 1))"""
_KEPT_POST = _POST.replace("from documents", "from kept")
_MAIN["d4_index_statistics"] = (f"{_KEPT}, {_KEPT_POST}", "select term, count(*) as df, any_value(st.n) as n, round(any_value(mean), 6) as mean from p, st group by term")
_MAIN["d5_index_search"] = (
    f"{_KEPT}, {_KEPT_POST}, {_ASKED}, {_BM25}",
    "select query_id, id, round(bm25, 6) as bm25 from (select *, row_number() over (partition by query_id order by round(bm25, 9) desc, id) as r from bm) where r <= 10",
)
ORACLE_SQL = {k: f"with {ctes} {select}" for k, (ctes, select) in _MAIN.items()}
