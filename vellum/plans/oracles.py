"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from vellum.functions import patterns as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{P.S}+|{P.S}+$')}, '', 'g')"


def squeeze(c: str) -> str:
    return f"regexp_replace({c}, {q(f'{P.S}+')}, '', 'g')"


def get(c: str, pattern: str, k: int = 0) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {k})"


def every(c: str, pattern: str, k: int = 0) -> str:
    return f"regexp_extract_all({c}, {q(pattern)}, {k})"


def cascade(c: str, steps, otherwise: bool) -> str:
    share = f"len({every(c, P.CJK)}) / greatest(length({c}), 1)"
    tests = {
        "has": lambda x: has(c, x), "not": lambda x: f"NOT {has(c, x)}", "longer": lambda x: f"length({c}) > {x}", "shorter": lambda x: f"length({c}) < {x}",
        "chinese": lambda x: f"{share} > {x}", "fewer": lambda x: f"len({every(c, P.OPERATORS)}) < {x}",
    }
    whens = " ".join(f"WHEN {' AND '.join(tests[k](x) for k, x in conditions)} THEN {str(verdict).lower()}" for verdict, conditions in steps)
    return f"(CASE {whens} ELSE {str(otherwise).lower()} END)"


def words(xs) -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


def is_title(c: str) -> str:
    return f"regexp_replace({squeeze(c)}, '[：:]+$', '') IN {words(P.REFERENCE_TITLES)}"


def is_caption(c: str) -> str:
    return f"(NOT {has(c, P.TOC_DOTS)} AND NOT {has(c, P.TOC_SPACES)} AND {has(c, P.CAPTION)})"


def is_heading(c: str) -> str:
    number, rest = get(c, P.HEADING, 1), strip(get(c, P.HEADING, 2))
    plain = f"length({rest}) BETWEEN 2 AND 60 AND lower({rest}) NOT IN {words(P.HEADING_NOT)} AND NOT {has(rest, '[，；：]')}"
    return f"(NOT {has(c, P.HEADING_DATE)} AND NOT {has(c, P.SENTENCE_END)} AND CASE WHEN {has(c, P.HEADING)} THEN {plain} AND NOT (NOT contains({number}, '.') AND {has(rest, '^[A-Za-z]{2,4}$')}) ELSE {has(c, P.HEADING_CHAPTER)} END)"


def goes_on(c: str) -> str:
    return f"(length({c}) BETWEEN 4 AND 90 AND NOT ({is_title(c)} OR {is_caption(c)} OR {is_heading(c)} OR {cascade(c, P.FORMULA, P.FORMULA_ELSE)} OR {has(c, f'^第{P.S}*[0-9]+{P.S}*页$')} OR {has(c, '[。！？]$')}))"


def likely(c: str, region: str = "region") -> str:
    long = f"(length({c}) > 20 AND {has(c, P.REFERENCE_WORDS)} OR length({c}) > 40 AND {has(c, P.REFERENCE_SPACED)})"
    return f"({region} = 'reference' OR {has(c, P.REFERENCE_LONE)} OR ({has(c, P.REFERENCE_START)} AND {long}))"


LINES = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
plain AS (SELECT doc_id, line_no, CAST((line_no - 1) // 8 + 1 AS INTEGER) AS page_num, line, CAST((doc_id * 31 + line_no * 17) % 13 AS INTEGER) AS h, (line_no - 1) % 8 AS slot FROM raw),
marked AS (SELECT *, CASE WHEN h = 0 THEN (1 + line_no % 4) || '.' || (1 + doc_id % 5) || ' Part ' || line_no WHEN h = 1 THEN 'Figure ' || (1 + line_no % 6) || ' What part ' || line_no || ' shows'
  WHEN h = 5 THEN 'x_' || line_no || ' = y^2 (' || (1 + line_no % 7) || ')' WHEN h = 10 AND line_no % 3 = 0 THEN 'References' END AS mark, CASE h
  WHEN 2 THEN line || ' [' || (1 + doc_id % 9) || ', ' || (1 + line_no % 12) || ']' WHEN 3 THEN line || ' (Smith, ' || (1990 + doc_id % 30) || ')' WHEN 4 THEN '[' || (1 + line_no % 10) || '] ' || line || ' vol. 3'
  WHEN 6 THEN line || ' see Figure ' || (1 + line_no % 9) WHEN 7 THEN line || ' TensorFlw and deep-learning' WHEN 8 THEN line || ' as noted.[' || (1 + doc_id % 5) || ']'
  WHEN 9 THEN line || ' from Eq. (' || (1 + line_no % 9) || ')' ELSE line END AS body FROM plain),
both_ AS (SELECT *, 0 AS nth, coalesce(mark, body) AS content FROM marked UNION ALL SELECT *, 1, body FROM marked WHERE mark IS NOT NULL),
lines AS (SELECT doc_id, line_no * 2 + nth AS line_no, page_num, h, content, CASE WHEN h = 0 AND nth = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS size,
  (72 + h % 3 * 10)::DOUBLE AS x0, (80 + slot * 80 + nth * 20)::DOUBLE AS y0, (272 + h % 3 * 10 + h * 20)::DOUBLE AS x1, (92 + slot * 80 + nth * 20)::DOUBLE AS y1 FROM both_)"""

#: Lines of the pages asked for of payloads that can be read.
ASKED_LINES = LINES.removesuffix(")") + "\n WHERE doc_id % 5 < 3 AND (doc_id % 3 = 0 OR page_num IN (1, doc_id % 4 + 1)))"

_cites = f"list_concat(CASE WHEN {has('c', P.CITATION_CODE)} THEN [] ELSE list_filter({every('c', P.CITATION_GROUP)}, lambda x: len(list_filter(string_split(regexp_replace({squeeze('x')}, '[\\[\\]]', '', 'g'), ','), lambda n: NOT coalesce(TRY_CAST(n AS BIGINT) BETWEEN 1 AND 999, false))) = 0) END, {every('c', P.CITATION_AUTHOR)})"

PARSED = f"""p0 AS (SELECT * REPLACE (content AS content), {strip('content')} AS c, median(size) OVER (PARTITION BY doc_id, page_num) AS body FROM lines WHERE {strip('content')} <> ''),
p1 AS (SELECT *, {is_title('c')} AS is_title, {is_caption('c')} AS is_caption, {goes_on('c')} AS goes_on FROM p0),
p2 AS (SELECT *, max(is_title::INT) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS refs, is_caption AND NOT is_title AS starts FROM p1),
p3 AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, page_num ORDER BY line_no) AS caption FROM p2),
p4 AS (SELECT *, row_number() OVER w AS nth, min(CASE WHEN starts THEN 1 ELSE goes_on::INT END) OVER w = 1 AS unbroken FROM p3 WINDOW w AS (PARTITION BY doc_id, page_num, caption ORDER BY line_no)),
p5 AS (SELECT *, caption > 0 AND NOT starts AND nth <= 3 AND unbroken AS joins FROM p4),
caps AS (SELECT doc_id, page_num, caption, string_agg(c, ' ' ORDER BY line_no) AS c_text, min(x0) AS cx0, min(y0) AS cy0, max(x1) AS cx1, max(y1) AS cy1 FROM p5 WHERE starts OR joins GROUP BY ALL),
p6 AS (SELECT p5.*, c_text, cx0, cy0, cx1, cy1, CASE WHEN is_title THEN 'title' WHEN starts THEN 'chart' WHEN {cascade('c', P.FORMULA, P.FORMULA_ELSE)} THEN 'formula' WHEN ({is_heading('c')} AND size >= body * 1.15) OR size >= body * 1.3 THEN 'title' ELSE 'main' END AS kind FROM p5 LEFT JOIN caps USING (doc_id, page_num, caption) WHERE NOT joins),
elements AS (SELECT doc_id, line_no * 100 + 99 AS seq, CASE WHEN is_title OR starts THEN 'title' WHEN refs THEN 'text' WHEN kind IN ('formula', 'title') THEN kind ELSE 'text' END AS type, CASE WHEN starts THEN c_text ELSE c END AS content,
  CASE WHEN starts THEN cx0 ELSE x0 END AS x0, CASE WHEN starts THEN cy0 ELSE y0 END AS y0, CASE WHEN starts THEN cx1 ELSE x1 END AS x1, CASE WHEN starts THEN cy1 ELSE y1 END AS y1, page_num,
  CASE WHEN is_title THEN 'reference' WHEN starts THEN 'chart' WHEN refs THEN 'reference' WHEN kind IN ('formula', 'title') THEN kind ELSE 'main' END AS region FROM p6
  UNION ALL SELECT doc_id, line_no * 100 + least(pos, 98), 'citation', cite, x0, y0, x1, y1, page_num, 'citation' FROM (SELECT *, unnest(cites) AS cite, unnest(range(len(cites))) AS pos FROM (SELECT *, {_cites} AS cites FROM p6 WHERE NOT is_title AND NOT starts)))"""

ELEMENTS = f"{LINES},\n{PARSED}"
#: Lines of which every third is a heading.
HEADING_LINES = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
marked AS (SELECT *, CASE line_no % 15 WHEN 0 THEN top || ' Alpha' WHEN 3 THEN top || '.' || sub || ' Beta' WHEN 6 THEN top || '.' || sub || '.2.1 Gamma' WHEN 9 THEN top || '.' || sub || ' Beta' WHEN 12 THEN top || '.1.1.1.1 Delta' END AS mark FROM (SELECT *, CAST(1 + line_no // 15 % 3 AS VARCHAR) AS top, CAST(1 + doc_id % 2 AS VARCHAR) AS sub FROM raw)),
both_ AS (SELECT *, 0 AS nth, coalesce(mark, line) AS content FROM marked UNION ALL SELECT *, 1, line FROM marked WHERE mark IS NOT NULL),
lines AS (SELECT doc_id, line_no * 2 + nth AS line_no, CAST((line_no - 1) // 8 + 1 AS INTEGER) AS page_num, content, CASE WHEN mark IS NOT NULL AND nth = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS size,
  72.0::DOUBLE AS x0, (80 + (line_no - 1) % 8 * 80 + nth * 20)::DOUBLE AS y0, 272.0::DOUBLE AS x1, (92 + (line_no - 1) % 8 * 80 + nth * 20)::DOUBLE AS y1 FROM both_)"""

NUMERIC = f"(?:^|[^\\p{{L}}\\p{{N}}_\\]]){P.CITATION_GROUP}"
_numeric = f"list_filter({every('content', NUMERIC, 1)}, lambda x: len(list_filter(string_split({squeeze('x')}, ','), lambda n: n <> '0')) > 0 AND len(list_filter(string_split({squeeze('x')}, ','), lambda n: n <> '0' AND coalesce(TRY_CAST(n AS BIGINT), 1000) >= 1000)) = 0)"
_author = every("content", P.AUTHOR_YEAR, 1)
_likely = likely("content")

REFERENCES = f"""lk AS (SELECT *, {_likely} AS likely FROM elements),
dd AS (SELECT doc_id, max(likely::INT) = 1 AS any_ref, max(page_num) AS last, arg_min(page_num, seq) FILTER (WHERE {has('content', P.REFERENCE_TITLE_LOOSE)}) AS titled FROM lk GROUP BY doc_id),
refs AS (SELECT lk.* FROM lk JOIN dd USING (doc_id) WHERE likely OR (NOT any_ref AND page_num >= coalesce(titled, greatest(CAST(round_even(last * 0.75, 0) AS INTEGER), 1)) AND length(content) >= 15 AND {has('content', P.REFERENCE_ITEM)})),
refnum AS (SELECT DISTINCT doc_id, coalesce(TRY_CAST(n AS INTEGER), 0) AS n FROM (SELECT doc_id, {get('content', P.REFERENCE_NUMBER, 1)} || {get('content', P.REFERENCE_NUMBER, 2)} AS n FROM refs) WHERE n <> ''),
refdoc AS (SELECT doc_id, count(*) AS n_refs, (SELECT max(n) FROM refnum WHERE refnum.doc_id = refs.doc_id) AS top FROM refs GROUP BY doc_id)"""

_layout_number = " || ".join(get("content", P.LAYOUT_REFERENCE_NUMBER, k) for k in range(1, 7))
FAULTS = f"""lr AS (SELECT doc_id, TRY_CAST({_layout_number} AS INTEGER) AS n FROM elements WHERE region = 'reference'),
ld AS (SELECT doc_id, coalesce(max(n) FILTER (WHERE n BETWEEN 1 AND 300), count(*)) AS top FROM lr GROUP BY doc_id),
ct AS (SELECT doc_id, seq, page_num, content, unnest({every('content', P.LAYOUT_GROUP, 1)}) AS inner_ FROM elements WHERE type = 'citation' AND NOT ({has('content', P.LAYOUT_AUTHOR_YEAR)} AND {has('content', '[A-Za-z]')})),
pt AS (SELECT doc_id, seq, page_num, content, unnest(regexp_split_to_array({strip('inner_')}, {q(P.LAYOUT_SPLIT)})) AS p FROM ct),
nm AS (SELECT *, TRY_CAST(p AS INTEGER) AS n FROM pt WHERE TRY_CAST(p AS INTEGER) > 0 AND TRY_CAST(p AS INTEGER) NOT BETWEEN 1800 AND 2100),
ok AS (SELECT doc_id, seq FROM nm GROUP BY ALL HAVING max(n) < 150),
faults AS (SELECT doc_id, seq, page_num, content, string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n) AS missing FROM (SELECT DISTINCT doc_id, seq, page_num, content, n FROM nm JOIN ok USING (doc_id, seq) LEFT JOIN ld USING (doc_id) WHERE (top IS NULL OR n <= top + 10) AND (doc_id, n) NOT IN (SELECT (doc_id, n) FROM lr WHERE n BETWEEN 1 AND 300)) GROUP BY ALL)"""

_label = lambda x: f"translate({squeeze(x)}, '−–—－.', '-----')"
EDGE = f"(?i)(?:^|[^一-鿿A-Za-z0-9])(?:图|表|Figure|Fig\\.?|Table){P.S}*({P.NUMBER})({P.DASH}?)"
LABELS = f"""cap AS (SELECT DISTINCT doc_id, {_label(get('content', P.CAPTION_NUMBER, 1))} AS n FROM elements WHERE type = 'title' AND {is_caption('content')}),
mn AS (SELECT doc_id, seq, page_num, content, unnest({every('content', EDGE, 1)}) AS n, unnest({every('content', EDGE, 2)}) AS d FROM elements WHERE type = 'text' AND region <> 'reference'),
labels AS (SELECT doc_id, seq, page_num, content, n FROM (SELECT doc_id, seq, page_num, content, {_label('n')} AS n FROM mn WHERE d = '' AND len({every('n', P.DASH)}) < 2) WHERE (doc_id, n) NOT IN (SELECT (doc_id, n) FROM cap))"""


def _formula_number(x: str) -> str:
    s = f"translate({squeeze(x)}, '−–—－', '----')"
    return f"CASE WHEN {has(s, '^[0-9]+(?:-[0-9]+)+$')} THEN replace({s}, '-', '.') ELSE {s} END"


FORMULAS = f"""fm AS (SELECT e.*, {_formula_number(get('content', P.FORMULA_END, 1))} AS number FROM elements e WHERE type = 'formula' AND {cascade('content', P.DISPLAY, P.DISPLAY_ELSE)} AND {has('content', P.FORMULA_END)}),
said AS (SELECT DISTINCT doc_id, {_formula_number('raw')} AS number FROM (SELECT doc_id, unnest(list_concat({every('content', P.FORMULA_MENTIONS[0], 1)}, {every('content', P.FORMULA_MENTIONS[1], 1)}, list_filter({every('content', P.FORMULA_PAREN, 1)}, lambda n: {has('n', P.DASH)}))) AS raw FROM elements WHERE type = 'text')),
un AS (SELECT fm.*, said.number IS NULL AS unsaid, sum((said.number IS NULL)::INT) OVER (PARTITION BY doc_id) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM fm LEFT JOIN said USING (doc_id, number))"""

HEADINGS = f"""pg AS (SELECT doc_id, page_num, max(y1) AS low FROM elements GROUP BY ALL),
cand AS (SELECT doc_id, seq, type, region, content, page_num, x0, y0, x1, y1, {get('content', P.HEADING, 1)} AS key, list_transform(string_split({get('content', P.HEADING, 1)}, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS parts FROM elements JOIN pg USING (doc_id, page_num)
  WHERE y0 > low * 0.08 AND y1 < low * 0.95 AND {is_heading('content')} AND {has('content', P.HEADING)} AND {has(strip(get('content', P.HEADING, 2)), f'[A-Za-z]|{P.CJK}')} AND NOT ({has('content', P.TOC_LEADER)} OR ({has('content', P.TOC_LEADER_SHORT)} AND {has('content', P.TOC_GAP)}))),
hd AS (SELECT * FROM cand WHERE type = 'title' AND region = 'title'),
hp AS (SELECT *, array_to_string(parts[:-2], '.') AS parent, parts[-1] AS child FROM hd),
hg AS (SELECT *, coalesce(max(child) OVER (PARTITION BY doc_id, parent ORDER BY page_num, y0, x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS expected FROM hp),
hw AS (SELECT *, CASE WHEN parent = '' THEN '' ELSE parent || '.' END || expected AS wanted FROM hg WHERE child > expected),
gaps AS (SELECT hw.* FROM hw LEFT JOIN (SELECT doc_id, key AS wanted, min((page_num, y0, x0)) AS at_ FROM cand GROUP BY ALL) USING (doc_id, wanted) WHERE at_ IS NULL OR NOT at_ < (page_num, y0, x0)),
dups AS (SELECT * FROM (SELECT *, row_number() OVER w AS nth, first_value(page_num) OVER w AS first_page FROM hd WINDOW w AS (PARTITION BY doc_id, key ORDER BY page_num, y0, x0, seq)) WHERE nth > 1)"""

FORBIDDEN = f"fb AS (SELECT doc_id, page_num FROM elements WHERE {has('content', '(?i)' + P.whole('deep-learning'))})"
_position = f"(?s).{{0,18}}{P.POSITION}"
POSITIONS = f"ps AS (SELECT doc_id, seq, page_num, unnest({every('content', _position)}) AS hit FROM elements WHERE NOT {_likely})"
STYLES = f"""st AS (SELECT doc_id, page_num, len({_numeric}) AS n, len(list_filter({_author}, lambda x: {strip('x')} <> '')) AS a FROM elements),
sd AS (SELECT doc_id, sum(n) AS n, sum(a) AS a, list_sort(list_distinct(list(page_num) FILTER (WHERE a > 0))) AS ap, list_sort(list_distinct(list(page_num) FILTER (WHERE a > 0 OR n > 0))) AS np FROM st GROUP BY doc_id)"""
MISSING = f"""cn AS (SELECT doc_id, seq, page_num, unnest({_numeric}) AS inner_ FROM elements),
cm AS (SELECT doc_id, seq, page_num, list_filter(list_transform(string_split({squeeze('inner_')}, ','), lambda n: TRY_CAST(n AS INTEGER)), lambda n: n <> 0) AS ns FROM cn),
cx AS (SELECT doc_id, seq, page_num, unnest(ns) AS n FROM cm WHERE len(list_filter(ns, lambda n: n >= 150)) = 0),
miss AS (SELECT doc_id, seq, page_num, n FROM cx JOIN refdoc USING (doc_id) WHERE n <= CASE WHEN top > 0 THEN top ELSE n_refs END + 10 AND (doc_id, n) NOT IN (SELECT (doc_id, n) FROM refnum))"""
AUTHORS = f"""ay AS (SELECT doc_id, seq, page_num, unnest({every('content', P.AUTHOR_YEAR_ANY, 1)}) AS inner_ FROM elements),
az AS (SELECT *, {get('inner_', '[0-9]{4}[a-z]?')} AS year, lower({get('inner_', '[A-Za-z][A-Za-z' + chr(39) + chr(92) + '-]+')}) AS author FROM ay),
ax AS (SELECT * FROM az WHERE author <> '' AND doc_id IN (SELECT doc_id FROM refs) AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.doc_id = az.doc_id AND contains(lower(refs.content), year) AND contains(lower(refs.content), author)))"""

_word = f"{P.W}+"
#: Likeness is bounded from above by the letters that two words have in common; in these tables no word is let through by
#: that which the likeness itself would stop.
_like = "2.0 * list_sum(list_transform(list_distinct(string_split(kw, '')), lambda x: least(length(word) - length(replace(word, x, '')), length(kw) - length(replace(kw, x, ''))))) / (length(word) + length(kw))"
TYPOS = f"""tw AS (SELECT doc_id, seq, page_num, unnest({every('content', _word)}) AS word FROM elements),
tn AS (SELECT doc_id, word, count(*) AS n FROM tw GROUP BY ALL),
tk AS (SELECT word, kw, ki, {_like} AS ratio FROM (SELECT DISTINCT word FROM tw), (VALUES ('TensorFlow', 1), ('Pydantic', 2)) v(kw, ki) WHERE abs(length(word) - length(kw)) <= 2 AND {_like} >= 0.85),
tr AS (SELECT *, least(n, 3 - coalesce(sum(n) OVER (PARTITION BY doc_id, kw ORDER BY ratio DESC, word DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS times FROM tn JOIN tk USING (word)),
ts AS (SELECT * FROM tr WHERE times > 0 AND lower(word) <> lower(kw) AND word <> kw || 's' AND word <> kw || 'es'),
typos AS (SELECT tw.*, kw FROM tw JOIN ts USING (doc_id, word)),
many AS (SELECT doc_id, CAST(sum(times * n) AS BIGINT) AS total, array_to_string(flatten(list(list_transform(range(least(3, CAST(times * n AS BIGINT))), lambda i: word) ORDER BY ki, ratio DESC, word DESC))[:3], ', ') AS samples FROM ts GROUP BY doc_id HAVING sum(times * n) > 10)"""

#: Elements that the check of marks would look at; these tables have none.
MARKED = f"mk AS (SELECT * FROM elements WHERE NOT {_likely} AND region NOT IN ('chart', 'formula') AND {has('content', f'{P.CJK}{P.S}*[,?!;:.]|[a-zA-Z]{{2}}{P.S}*[，。？！；：]')})"

#: All issues that the flagship audit finds; without images their two checks find none: (doc_id, seq, issue_type, severity, page, evidence, message, box).
ISSUES = f"""{ELEMENTS}, {REFERENCES}, {FAULTS}, {LABELS}, {FORMULAS}, {HEADINGS}, {FORBIDDEN}, {POSITIONS}, {STYLES}, {MISSING}, {AUTHORS}, {TYPOS}, {MARKED},
found AS (SELECT doc_id, seq, 'Label_Missing' AS issue_type, 'Info' AS severity, CAST(page_num AS VARCHAR) AS page, content AS evidence, '正文引用的图表编号未在图表标题中找到' AS message, 0 AS part FROM labels
 UNION ALL SELECT doc_id, seq, 'Formula_Ref_Missing', 'Info', CAST(page_num AS VARCHAR), content, '公式编号未在正文引用中出现', 0 FROM un WHERE unsaid AND k >= 3 AND k / n >= 0.2
 UNION ALL SELECT doc_id, seq, 'Formula_Misaligned', 'Warning', CAST(page_num AS VARCHAR), content, '公式编号疑似未右对齐', 0 FROM fm JOIN (SELECT doc_id, page_num, max(x1) AS max_x FROM elements GROUP BY ALL) USING (doc_id, page_num) WHERE x1 < max_x * 0.6
 UNION ALL SELECT doc_id, seq, 'Hierarchy_Fault', 'Info', CAST(page_num AS VARCHAR), content, '标题序号重复: ' || key || ' (首次出现: 第' || first_page || '页)', 1 FROM dups
 UNION ALL SELECT doc_id, seq, 'Hierarchy_Fault', 'Info', CAST(page_num AS VARCHAR), content, '标题序号不连续 (期望: ' || wanted || ')', 3 FROM gaps
 UNION ALL SELECT doc_id, seq, 'Citation_Visual_Fault', 'Warning', CAST(page_num AS VARCHAR), content, '引用标注在参考文献区未找到对应条目: ' || missing, 0 FROM faults
 UNION ALL SELECT doc_id, 0, 'Terminology_Forbidden', 'Warning', array_to_string(list_sort(list(DISTINCT page_num)), ', '), 'deep-learning', '检测到不规范术语写法，建议使用：deep learning', 0 FROM fb GROUP BY doc_id
 UNION ALL SELECT doc_id, seq, 'Citation_Position_Inconsistent', 'Info', CAST(page_num AS VARCHAR), hit, '引用标注位置错误 (应置于标点符号之前)', 0 FROM ps
 UNION ALL SELECT doc_id, 0, 'Citation_Style_Inconsistent', 'Warning', array_to_string(np, ', '), 'numeric + author-year', '正文引用风格不一致', 0 FROM sd WHERE n > 0 AND a > 0
 UNION ALL SELECT doc_id, 0, 'Citation_Style_Mismatch', 'Warning', array_to_string(ap, ', '), 'author-year', '引用风格与配置不一致，建议使用数字编号引用', 0 FROM sd WHERE a > 0
 UNION ALL SELECT doc_id, 0, 'Reference_List_Missing', 'Warning', '?', '', '正文存在引用标注，但未检测到参考文献列表', 0 FROM sd WHERE (n > 0 OR a > 0) AND doc_id NOT IN (SELECT doc_id FROM refs)
 UNION ALL SELECT doc_id, seq, 'Citation_Reference_Missing', 'Info', CAST(page_num AS VARCHAR), '[' || n || ']', '引用标注未在参考文献中找到对应编号', 0 FROM miss
 UNION ALL SELECT doc_id, seq, 'Citation_Reference_Missing', 'Info', CAST(page_num AS VARCHAR), '(' || inner_ || ')', '作者-年份引用未在参考文献中找到对应条目', 1 FROM ax
 UNION ALL SELECT doc_id, seq, 'Critical_Keyword_Typo', 'Critical', CAST(page_num AS VARCHAR), word, '关键术语拼写错误: ' || chr(39) || word || chr(39) || ' 应为 ' || chr(39) || kw || chr(39), 0 FROM typos
 UNION ALL SELECT doc_id, 0, 'Typo_Limit_Exceeded', 'Warning', '?', 'Found ' || total || ' typos (including: ' || samples || '...)', '全文错别字数量超过红线 (10个)', 0 FROM many
 UNION ALL SELECT doc_id, seq, 'Punctuation_Mixed', 'Info', CAST(page_num AS VARCHAR), content, 'marks', 0 FROM mk),
-- Checks that belong to no element have no box; others are the same only if their element's box is, too.
boxed AS (SELECT f.*, CASE WHEN issue_type IN ('Label_Missing', 'Formula_Ref_Missing', 'Formula_Misaligned', 'Hierarchy_Fault', 'Citation_Visual_Fault') THEN concat_ws(',', x0, y0, x1, y1) ELSE '' END AS box FROM found f LEFT JOIN elements e USING (doc_id, seq)),
issues AS (SELECT doc_id, issue_type, severity, page, evidence, message, box, min((part, seq)) AS place FROM boxed GROUP BY doc_id, issue_type, severity, page, evidence, message, box)"""
PAGES = "dp AS (SELECT doc_id, CASE WHEN min(page_num) = max(page_num) THEN CAST(min(page_num) AS VARCHAR) ELSE min(page_num) || '-' || max(page_num) END AS pages FROM elements GROUP BY doc_id)"
COUNTS = "cs AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'Critical') AS c, count(*) FILTER (WHERE severity = 'Warning') AS w, count(*) FILTER (WHERE severity NOT IN ('Critical', 'Warning')) AS i FROM issues GROUP BY doc_id)"
_score = "CAST(greatest(least(100 - round_even(coalesce(c, 0) * 5.0 + sqrt(coalesce(w, 0)) * 2.0 + sqrt(coalesce(i, 0)) * 0.3, 0), 100), 0) AS INTEGER)"
_tag = "CASE WHEN contains(lower(issue_type), 'citation') OR contains(lower(issue_type), 'reference') THEN 'Citation_Inconsistency' WHEN issue_type IN ('Label_Missing', 'Hierarchy_Fault') THEN issue_type WHEN contains(lower(issue_type), 'punctuation') THEN 'Punctuation_Error' END"
TAGS = f"tg AS (SELECT doc_id, string_agg(DISTINCT {_tag}, ',' ORDER BY {_tag}) AS tags FROM issues GROUP BY doc_id)"


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def on(*ctes: str) -> str:
    return ", ".join([ELEMENTS, *ctes])


HEADING_ELEMENTS = f"{HEADING_LINES},\n{PARSED}, {HEADINGS}"
MIXED = (f"(?i)\\bdeep{P.S}+learning\\b|\\bdeep-learning\\b", "(?i)\\bTensorFlw\\b")
IMAGES = f"""imgs AS (SELECT DISTINCT doc_id, page_num, 90.0 AS x0, (100 + doc_id % 5 * 80)::DOUBLE AS y0, 290.0 AS x1, (240 + doc_id % 5 * 80)::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN 5.5 ELSE 0 END AS y1 FROM lines WHERE page_num % 2 = 1),
pgs AS (SELECT doc_id, page_num, max(x1) AS max_x, max(y1) AS max_y FROM (SELECT doc_id, page_num, x1, y1 FROM elements UNION ALL SELECT doc_id, page_num, x1, y1 FROM imgs) GROUP BY ALL),
figs AS (SELECT * FROM elements WHERE type = 'title' AND {is_caption('content')} AND {has('content', P.FIGURE_CAPTION)})"""
OFFSETS = "ofs AS (SELECT *, start + length(content) AS stop FROM (SELECT doc_id, seq, page_num, content, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM elements))"
_added = "content || '，一二,'"
_start, _stop = "least(a, length(flat))", "least(b, length(flat))"
_snippet = f"CASE WHEN greatest({_start} - 18, 0) > 0 THEN '…' ELSE '' END || substr(flat, greatest({_start} - 18, 0) + 1, least({_stop} + 18, length(flat)) - greatest({_start} - 18, 0)) || CASE WHEN least({_stop} + 18, length(flat)) < length(flat) THEN '…' ELSE '' END"
#: Marks of the wrong script in lines that end with some: by the share of Chinese either the last comma or the first is wrong.
MARKS = f"""mm AS (SELECT doc_id, seq, {_added} AS c, {strip('regexp_replace(' + _added + f", {q(P.S + '+')}, ' ', 'g')")} AS flat, len({every(_added, P.CJK)}) AS zh, len({every(_added, '[A-Za-z]')}) AS la, len({every(_added, '[0-9]')}) AS di, {get('content', '[a-zA-Z]{2,}$')} AS tail, length(content) AS n, region FROM elements),
ml AS (SELECT * FROM mm WHERE NOT {likely('c')} AND region NOT IN ('chart', 'formula') AND NOT {has('c', 'https?://|@[A-Za-z0-9_.-]+')} AND NOT {has('c', '[∧∨¬⇒⇔∑∫√∂∇∞≈≠≤≥±×÷]')} AND len({every('c', '[=<>≤≥±×÷*/+' + chr(92) + '-≈≠]')}) < 2),
mh AS (SELECT *, n + 2 AS a, n + 4 AS b, '中文文本使用了英文标点' AS message FROM ml WHERE zh / greatest(zh + la + di, 1) >= 0.5
  UNION ALL SELECT *, n - length(tail), n + 1, '英文文本使用了中文标点' FROM ml WHERE la >= 5 AND la / greatest(zh + la + di, 1) >= 0.8 AND tail <> '' AND NOT (NOT contains(c, ' ') AND length(c) < 50))"""
REGIONS = f"""{LINES},
rp AS (SELECT DISTINCT doc_id, page_num, (doc_id + page_num) % 7 AS k FROM lines),
rc AS (SELECT *, 200.0 + k * 50 AS c0, 212.0 + k * 50 AS c1, unnest([0, 1, 2]) AS n FROM rp),
rb AS (SELECT *, (90 + n * 95)::DOUBLE AS x0, (120 + n * 170)::DOUBLE AS y0, (330 + n * 60)::DOUBLE AS x1, (180 + n * 175)::DOUBLE AS y1 FROM rc),
rg AS (SELECT *, -(x1 - x0) * (y1 - y0) AS neg, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS box, least(300, x1) - greatest(100, x0) > 0 AND least(300, x1) - greatest(100, x0) >= least(200, x1 - x0) * 0.2 AND NOT (k % 2 = 0 AND y0 > c1 + 6) AND NOT (k % 2 = 1 AND y1 < c0 - 6) AS reach,
  CASE WHEN y1 <= c0 THEN c0 - y1 WHEN y0 >= c1 THEN y0 - c1 ELSE 0 END * 1000 + abs(200 - (x0 + x1) / 2) AS score FROM rb)"""


def _math(compat: bool) -> str:
    signs = "[=<>≤≥±×÷*/+\\\\-≈≠]" if compat else "[=<>≤≥±×÷*/+\\-≈≠]"
    lone = f"({has('content', '(?:^|[^A-Za-z0-9_])[A-Za-z](?:$|[^A-Za-z0-9_])')} AND {has('content', '可满足|不满足|满足|等价|推出|蕴含|合取|析取|否定')})"
    return f"({has('content', '[∧∨¬⇒⇔∑∫√∂∇∞≈≠≤≥±×÷]')} OR {lone} OR len({every('content', signs)}) >= 2)"


ORACLES: dict[str, str] = {
    "elements_decorated": over(LINES, "SELECT doc_id, line_no, page_num, h, content FROM lines"),
    "page_stats": over(LINES, f"SELECT doc_id, page_num, count(*) AS n_lines, CAST(length({strip('string_agg(' + strip('content') + chr(44) + chr(39) * 2 + ' ORDER BY line_no)')}) AS BIGINT) AS n_chars, length({strip('string_agg(' + strip('content') + chr(44) + chr(39) * 2 + ' ORDER BY line_no)')}) < 10 AS scanned, max(x1) AS max_x, max(y1) AS max_y FROM lines GROUP BY ALL"),
    "elements_parsed": over(ELEMENTS, "SELECT doc_id, seq, type, region, content, x0, y0, x1, y1, page_num FROM elements"),
    "element_region_counts": over(ELEMENTS, "SELECT doc_id, type, region, count(*) AS n FROM elements GROUP BY ALL"),
    "reference_titles": over(LINES, f"SELECT doc_id, line_no FROM lines WHERE {is_title('content')}"),
    "captions": over(LINES, f"SELECT doc_id, line_no, content, {_label(get(strip('content'), P.CAPTION_NUMBER, 1))} AS number FROM lines WHERE {is_caption(strip('content'))}"),
    "headings": over(LINES, f"SELECT doc_id, line_no, {get(strip('content'), P.HEADING, 1)} AS number FROM lines WHERE {is_heading(strip('content'))}"),
    "toc_headings": over(LINES, f"SELECT doc_id, line_no, content || ' ..... ' || line_no AS entry FROM lines WHERE {has(strip('content || ' + q(' ..... ') + ' || line_no'), P.TOC_LEADER)}"),
    "numeric_citations": over(LINES, f"SELECT doc_id, line_no, unnest({_numeric}) AS citation FROM lines"),
    "layout_citations": over(LINES, f"SELECT doc_id, line_no, unnest({_cites}) AS citation FROM (SELECT *, content AS c FROM lines)"),
    "author_year_citations": over(LINES, f"SELECT doc_id, line_no, {strip('unnest(' + _author + ')')} AS citation FROM lines"),
    "reference_numbers": over(LINES, f"SELECT * FROM (SELECT doc_id, line_no, {get('content', P.REFERENCE_NUMBER, 1)} || {get('content', P.REFERENCE_NUMBER, 2)} AS number FROM lines) WHERE number <> ''"),
    "formula_candidates": over(LINES, f"SELECT doc_id, line_no, content FROM lines WHERE {cascade(strip('content'), P.FORMULA, P.FORMULA_ELSE)}"),
    "display_formulas": over(LINES, f"SELECT doc_id, line_no, content FROM lines WHERE {strip('content')} <> '' AND {cascade(strip('content'), P.DISPLAY, P.DISPLAY_ELSE)}"),
    "likely_references": over(LINES, f"SELECT doc_id, line_no FROM lines WHERE {likely('content', chr(39) + 'main' + chr(39))}"),
    "reference_mode_latch": over(LINES, f"SELECT doc_id, line_no, max({is_title('content')}::INT) OVER (PARTITION BY doc_id ORDER BY line_no) = 1 AS in_references FROM lines"),
    "text_offsets": over(ELEMENTS, "SELECT doc_id, seq, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(content) AS BIGINT) AS stop FROM elements"),
    "level_rule_point_map": "SELECT t AS issue_type, CASE t " + " ".join(f"WHEN {q(k)} THEN {q(f'{P.RULE_PREFIX}-{n}')}" for k, (n, _) in P.ISSUE_RULES.items()) + f" ELSE {q(P.RULE_PREFIX + '-AUTO-')} || t END AS rule_id, CASE t " + " ".join(f"WHEN {q(k)} THEN {q(p)}" for k, (_, p) in P.ISSUE_RULES.items()) + " ELSE t END AS point, CASE WHEN lower(event_type) IN ('click') THEN 3 ELSE 1 END AS score FROM (SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'Label_Missing' WHEN 'purchase' THEN 'Formula_Missing' ELSE event_type END AS t FROM events)",
    "page_num_normalize": "SELECT event_id, greatest(coalesce(TRY_CAST(regexp_extract(page, '-?[0-9]+', 0) AS INTEGER), 0), 0) AS page FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'p. ' || (event_id % 50) WHEN 1 THEN '-' || (event_id % 9) WHEN 2 THEN event_type ELSE (event_id % 30) || '-' || (event_id % 40) END AS page FROM events)",
    "bbox_normalize": "SELECT vec_id, CASE WHEN vec_id % 6 > 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) ELSE 0 END AS x0, CASE WHEN vec_id % 6 > 1 THEN round(CAST(embedding[2] AS DOUBLE), 6) ELSE 0 END AS y0, CASE WHEN vec_id % 6 > 2 THEN round(CAST(embedding[3] AS DOUBLE), 6) ELSE 0 END AS x1, CASE WHEN vec_id % 6 > 3 THEN round(CAST(embedding[4] AS DOUBLE), 6) ELSE 0 END AS y1 FROM embeddings",
    "weight_clamp": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN least(greatest(value / 100, 0.0), 1.0) END AS weight FROM events",
    "page_lists": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ',') AS pages FROM (SELECT conv_id, turn, least(conv_id % 7, turn) + 1 AS a, greatest(conv_id % 7, turn) + 1 AS b, conv_id % 11 + 1 AS c FROM conversations)",
    "review_issue_type": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Typo_Error' WHEN 1 THEN 'Hierarchy_Fault' WHEN 2 THEN 'Label_Missing' WHEN 3 THEN 'Citation_Reference_Missing' WHEN 4 THEN 'Formatting_Issue' ELSE 'Other' END AS issue_type, CASE doc_id % 6 WHEN 0 THEN 'Warning' WHEN 2 THEN 'Critical' WHEN 3 THEN 'Warning' ELSE 'Info' END AS severity FROM documents",
    "citation_visual_fault": over(on(FAULTS), "SELECT doc_id, seq, CAST(page_num AS VARCHAR) AS page, content AS evidence, '引用标注在参考文献区未找到对应条目: ' || missing AS message FROM faults"),
    "citation_reference_missing": over(on(REFERENCES, MISSING), "SELECT doc_id, seq, CAST(page_num AS VARCHAR) AS page, '[' || n || ']' AS evidence FROM miss"),
    "author_year_missing": over(on(REFERENCES, AUTHORS), "SELECT doc_id, seq, CAST(page_num AS VARCHAR) AS page, '(' || inner_ || ')' AS evidence FROM ax"),
    "label_missing_mentions": over(on(LABELS), "SELECT doc_id, seq, CAST(page_num AS VARCHAR) AS page, content AS evidence FROM labels"),
    "formula_numbering": over(on(FORMULAS), "SELECT doc_id, seq, number FROM fm"),
    "formula_ref_missing": over(on(FORMULAS), "SELECT doc_id, seq, content AS evidence FROM un WHERE unsaid AND k >= 3 AND k / n >= 0.2"),
    "citation_style": over(on(STYLES), "SELECT doc_id, 'Citation_Style_Inconsistent' AS issue_type, array_to_string(np, ', ') AS page FROM sd WHERE n > 0 AND a > 0 UNION ALL SELECT doc_id, 'Citation_Style_Mismatch', array_to_string(ap, ', ') FROM sd WHERE a > 0"),
    "reference_list_missing": over(on(REFERENCES, STYLES), "SELECT doc_id FROM sd WHERE (n > 0 OR a > 0) AND doc_id NOT IN (SELECT doc_id FROM refs)"),
    "heading_depth": over(on(HEADINGS), "SELECT doc_id, CAST(max(len(parts)) AS INTEGER) AS depth, count(*) AS n FROM hd GROUP BY doc_id"),
    "heading_duplicates": over(HEADING_ELEMENTS, "SELECT doc_id, seq, key, first_page FROM dups"),
    "heading_gaps": over(on(HEADINGS), "SELECT doc_id, seq, wanted FROM gaps"),
    "heading_jumps": over(HEADING_ELEMENTS + ", hj AS (SELECT *, lag(page_num) OVER w AS p_page, lag((x0 + x1) / 2) OVER w AS p_cx, lag(parts) OVER w AS p_parts FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, y0, x0, seq))", "SELECT doc_id, seq, '标题层级跳跃' AS message FROM hj WHERE p_page = page_num AND abs((x0 + x1) / 2 - p_cx) < 200 AND len(parts) > len(p_parts) + 1 AND parts[:len(p_parts)] = p_parts"),
    "terminology_mixed_forms": over(on(f"mf AS (SELECT doc_id, page_num, list_transform(list_concat({every('content', MIXED[0])}, {every('content', MIXED[1])}), lambda x: regexp_replace(lower(x), '[_-]+', ' ', 'g')) AS used FROM elements)"), "SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(used))))[:6], ', ') AS evidence, array_to_string(list_sort(list(DISTINCT page_num)), ', ') AS page FROM mf WHERE len(used) > 0 GROUP BY doc_id HAVING len(list_distinct(flatten(list(used)))) > 1"),
    "typo_keywords": over(on(TYPOS), "SELECT DISTINCT doc_id, 'Critical_Keyword_Typo' AS issue_type, CAST(page_num AS VARCHAR) AS page, word AS evidence, '关键术语拼写错误: ' || chr(39) || word || chr(39) || ' 应为 ' || chr(39) || kw || chr(39) AS message FROM typos UNION ALL SELECT doc_id, 'Typo_Limit_Exceeded', '?', 'Found ' || total || ' typos (including: ' || samples || '...)', '全文错别字数量超过红线 (10个)' FROM many"),
    "commentary": over(ISSUES, "SELECT doc_id, '发现以下问题：' || chr(10) || string_agg('- ' || issue_type || ': ' || n, chr(10) ORDER BY n DESC, issue_type) AS comment, '请优先修复 Critical/Warning，再统一排版细节。' AS suggestion FROM (SELECT doc_id, issue_type, count(*) AS n FROM issues GROUP BY ALL) GROUP BY doc_id"),
    "image_caption_match": over(on(IMAGES), "SELECT DISTINCT c.doc_id, c.seq, CAST(c.page_num AS VARCHAR) AS page, c.content AS evidence, '图标题应位于图下方 (规则要求: bottom)' AS message FROM figs c JOIN imgs i USING (doc_id, page_num) JOIN pgs USING (doc_id, page_num) WHERE c.y0 - i.y1 <= max_y * 0.33 AND c.y0 - i.y1 >= -6 AND (c.x0 + c.x1) / 2 BETWEEN i.x0 - max_x * 0.02 AND i.x1 + max_x * 0.02 AND c.y0 < i.y1 - 5"),
    "select_pages": over(LINES, "SELECT doc_id, line_no, page_num FROM lines WHERE doc_id % 3 = 0 OR page_num IN (1, doc_id % 4 + 1)"),
    "parse_report": over(LINES, f"SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE scanned) AS scanned_pages, count(*) FILTER (WHERE several) AS multi_column_pages FROM (SELECT doc_id, page_num, length({strip('string_agg(' + strip('content') + chr(44) + chr(39) * 2 + ' ORDER BY line_no)')}) < 10 AS scanned, (doc_id + page_num) % 4 = 0 AND max(line_no % 2) > 0 AS several FROM lines GROUP BY doc_id, page_num) GROUP BY doc_id"),
    "page_ranges": over(on(OFFSETS, "pl AS (SELECT doc_id, unnest(range(0, CAST(max(stop) AS BIGINT) + 1, 700)) AS start FROM ofs GROUP BY doc_id)"), "SELECT pl.doc_id, pl.start, pl.start + 700 AS stop, CASE WHEN min(page_num) IS NULL THEN '?' WHEN min(page_num) = max(page_num) THEN CAST(min(page_num) AS VARCHAR) ELSE min(page_num) || '-' || max(page_num) END AS pages FROM pl LEFT JOIN ofs ON pl.doc_id = ofs.doc_id AND greatest(pl.start, ofs.start) < least(pl.start + 700, ofs.stop) GROUP BY ALL"),
    "document_pages": over(f"{ELEMENTS}, {PAGES}", """SELECT d.doc_id, coalesce(dp.pages, CASE WHEN own % 4 = 1 THEN CASE WHEN own % 9 IN (0, 5) THEN '5' ELSE least(5, own % 9) || '-' || greatest(5, own % 9) END
  WHEN own % 4 = 2 AND own % 3 > 0 THEN CASE WHEN own % 3 = 1 THEN '1' ELSE '1-2' END WHEN own % 4 > 1 THEN CASE WHEN own % 7 IN (0, 3) THEN '3' ELSE least(3, own % 7) || '-' || greatest(3, own % 7) END ELSE 'N/A' END) AS pages
  FROM (SELECT doc_id, doc_id AS own FROM documents UNION ALL SELECT -doc_id - 1, doc_id FROM documents) d LEFT JOIN dp ON d.doc_id = dp.doc_id"""),
    "request_faults": "SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'request_id' END, CASE WHEN event_id % 5 = 0 THEN 'paper_id' END, CASE WHEN event_id % 7 = 0 THEN 'paper_title' END, CASE WHEN event_id % 13 = 0 THEN 'chunk_id' END, CASE WHEN event_id % 4 = 0 THEN 'temperature' END, CASE WHEN event_id % 3 = 0 THEN 'max_tokens' END) AS faults FROM events",
    "result_faults": "SELECT event_id, concat_ws(',', CASE WHEN event_id % 130 < 10 OR event_id % 130 > 110 THEN 'score' END, CASE WHEN event_id % 3 = 0 THEN 'tags' END, CASE WHEN event_id % 5 = 0 THEN 'tokens' END, CASE WHEN event_id % 6 = 0 THEN 'latency_ms' END) AS faults FROM events",
    "compact_issues": "SELECT user_id AS doc_id, event_id AS seq, '{\"issue_type\":\"' || event_type || '\"' || CASE WHEN event_id % 2 = 0 THEN ',\"severity\":\"Info\"' ELSE '' END || ',\"message\":\"a ' || chr(92) || '\"b' || chr(92) || '\"\"' || CASE event_id % 3 WHEN 0 THEN ',\"page_num\":' || (event_id % 50) WHEN 1 THEN ',\"page_num\":\"3-5\"' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN ',\"bbox\":[0.5,1.5,2.5,3.5]' ELSE '' END || '}' AS issue FROM events",
    "expert_upsert": "SELECT c_mktsegment AS metric_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 't' END || c_custkey AS text, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Warning' ELSE 'Info' END WHEN 1 THEN 'Critical' ELSE 'Info' END AS severity, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS weight, 'seed' AS source, true AS active FROM customer UNION ALL SELECT 'fresh', 'f' || c_custkey, NULL, NULL, 'admin', true FROM customer WHERE c_custkey % 10 = 2",
    "truth_upsert": "SELECT c_mktsegment AS issue_type, 's' || c_custkey AS sample_id, 'e' || c_custkey AS evidence, 'm' AS message, CASE c_custkey % 4 WHEN 1 THEN 'Warning' WHEN 2 THEN 'Critical' ELSE 'Info' END AS severity, 'old' AS source FROM customer UNION ALL SELECT 'New', 'n' || c_custkey, 'x', NULL, NULL, NULL FROM customer WHERE c_custkey % 8 = 7",
    "truth_upsert_counts": "SELECT count(*) FILTER (WHERE c_custkey % 8 = 7) AS inserted, count(*) FILTER (WHERE c_custkey % 4 IN (1, 2)) AS updated, count(*) FILTER (WHERE c_custkey % 8 = 3) AS skipped FROM customer",
    "issue_evaluation": over(on(LABELS), "SELECT doc_id, CASE WHEN k IN (0, 1) THEN n ELSE 0 END AS tp, CASE WHEN k IN (0, 1) THEN 0 ELSE n END AS fp, CASE WHEN k IN (0, 1) THEN 0 ELSE m END AS fn, CASE WHEN k IN (0, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN k IN (0, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, CASE WHEN k IN (0, 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS f1 FROM (SELECT doc_id, doc_id % 5 AS k, count(DISTINCT (page_num, lower(trim(content)), x0, y0, x1, y1)) AS n, CASE doc_id % 5 WHEN 3 THEN count(DISTINCT (lower(trim(content)), x0, y0, x1, y1)) WHEN 4 THEN count(DISTINCT (page_num, lower(trim(content)))) ELSE count(DISTINCT (page_num, lower(trim(content)), x0, y0, x1, y1)) END AS m FROM labels JOIN elements USING (doc_id, seq, page_num, content) GROUP BY doc_id)"),
    "mask_urls": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Hidden' ELSE regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || '://***@' || lower(regexp_extract(url, '^[a-z]+://([^/?#@:]+)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#@:]+(:[0-9]+)?(/[^?#]*)?', 1) || regexp_extract(url, '^[a-z]+://[^/?#@:]+(:[0-9]+)?(/[^?#]*)?', 2) END AS masked FROM (SELECT page_id, url, CASE WHEN page_id % 5 = 1 THEN 'postgresql://' ELSE url END AS u FROM pages)",
    "text_helpers": f"SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens, {has('text', '(?i)' + P.whole('the'))} AS the, contains(text, '图') AS chart, md5(CASE WHEN {has('text', '[A-Za-z]')} THEN lower(text) ELSE text END) AS key_md5, CASE WHEN length(flat) > 120 THEN substr(flat, 1, 119) || '…' ELSE flat END AS short FROM (SELECT *, {strip(f'regexp_replace(text, {q(P.S + chr(43))}, {q(chr(32))}, {q(chr(103))})')} AS flat FROM documents)",
    "page_boxes": over(LINES, "SELECT doc_id, line_no, round(x0 / 600, 6) AS x0, round(y0 / 800, 6) AS y0, round(x1 / 600, 6) AS x1, round(y1 / 800, 6) AS y1, printf('[%.1f, %.1f, %.1f, %.1f]', x0, y0, x1, y1) AS said FROM lines"),
    "ordered_rules": "SELECT n_name AS rule_id, n_nationkey AS content FROM nation ORDER BY n_name",
    "numbered_issues": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, {strip('line')} || CASE WHEN line_no % 3 = 0 THEN ' more of it' ELSE '' END AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) WHERE {strip('line')} <> ''",
    "reembed_missing": "SELECT conv_id * 1000 + turn AS comment_id, 768 AS width, 1.0::DOUBLE AS norm FROM conversations WHERE turn % 2 = 0 AND length(trim(text)) > 0 ORDER BY 1 LIMIT 2000",
    "punctuation_mixed": over(on(MARKS), f"SELECT doc_id, seq, {_snippet} AS evidence, message FROM mh"),
    "captioned_regions": over(REGIONS, "SELECT doc_id, page_num, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM (SELECT doc_id, page_num, coalesce(arg_min(box, (score, neg, y0, x0)) FILTER (WHERE reach), arg_min(box, (neg, y0, x0))) AS b FROM rg GROUP BY ALL)"),
    "frontend_payload": over(on(LABELS), """SELECT doc_id, '[' || string_agg('{"issue_type":"Label_Missing","severity":"Info","page":"' || page_num || '","bbox":' || box || ',"evidence":' || to_json(content) || ',"message":"正文引用的图表编号未在图表标题中找到","anchor_id":"' || md5('Label_Missing-' || page_num || '-' || replace(box, ',', ', ')) || '","highlight":' || box || '}', ',' ORDER BY seq) || ']' AS payload FROM (SELECT *, printf('[%.1f,%.1f,%.1f,%.1f]', x0, y0, x1, y1) AS box FROM labels JOIN elements USING (doc_id, seq, page_num, content)) GROUP BY doc_id"""),
    "chinese_numbers": "SELECT event_id, CAST(event_id % 9999 + 1 AS INTEGER) AS value FROM events",
    "line_tests": over(LINES, f"SELECT doc_id, line_no, {_math(False)} AS math, {_math(True)} AS math_compat, md5(lower(regexp_replace(content, {q(P.S + '|' + P.MARKS)}, '', 'g'))) AS match_md5, TRY_CAST({get('content', '[0-9]+')} AS BIGINT) AS number FROM lines"),
    "open_payloads": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'encrypted_pdf' ELSE 'invalid_pdf' END AS error FROM documents",
    "span_trees": f"SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS page_num, md5(content) AS content_md5, bbox FROM (SELECT doc_id, unnest([trim('a' || text), 'b', 'alone', trim('a' || text) || 'b']) AS content, unnest(['1,2,3,4', '0,3,5,6', '7,7,8,8', '0,2,5,6']) AS bbox FROM documents)",
    "terminology_forbidden": over(on(FORBIDDEN), "SELECT doc_id, 'deep-learning' AS evidence, array_to_string(list_sort(list(DISTINCT page_num)), ', ') AS page FROM fb GROUP BY doc_id"),
    "citation_position": over(on(POSITIONS), "SELECT doc_id, seq, hit AS evidence FROM ps"),
    "dedupe_issues": over(ISSUES, "SELECT doc_id, issue_type, severity, count(*) AS n FROM issues GROUP BY ALL"),
    "severity_counts": over(f"{ISSUES}, {COUNTS}", "SELECT doc_id, c AS n_critical, w AS n_warning, i AS n_info FROM cs"),
    "issue_counts": over(ISSUES, "SELECT issue_type, count(*) AS n FROM issues GROUP BY ALL"),
    "score_level": over(f"{ISSUES}, {COUNTS}", f"SELECT doc_id, {_score} AS score, CASE WHEN {_score} < 60 THEN 'Critical' WHEN {_score} < 80 THEN 'Warning' ELSE 'Info' END AS audit_level FROM documents LEFT JOIN cs USING (doc_id)"),
    "report_lines": over(f"{ISSUES}, {COUNTS}, {PAGES}", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t, p, n, line) AS line_no, line FROM (
 SELECT doc_id, '' AS t, 0 AS p, n, CASE n WHEN 0 THEN '# Audit report' WHEN 1 THEN 'Score: ' || score ELSE 'Level: ' || CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 80 THEN 'WARNING' ELSE 'PASS' END END AS line FROM (SELECT doc_id, {_score} AS score, unnest([0, 1, 2]) AS n FROM documents LEFT JOIN cs USING (doc_id))
 UNION ALL SELECT doc_id, issue_type, -1, 0, '## ' || issue_type || ' (' || count(*) || ')' FROM issues GROUP BY doc_id, issue_type
 UNION ALL SELECT doc_id, issue_type, place[1], place[2], '- [' || severity || '] p' || CASE WHEN page IN ('', '?') THEN pages ELSE page END || ': ' || message FROM issues LEFT JOIN dp USING (doc_id))"""),
    "score_report": over(f"{ISSUES}, {COUNTS}", f"""SELECT doc_id, n AS line_no, CASE n WHEN 1 THEN '# 论文格式审计评分报告' WHEN 3 THEN '**文件名**: ' || doc_id || '.pdf' WHEN 5 THEN '**审计时间**: 2024-05-01 12:30:00' WHEN 7 THEN '## 审计结果'
  WHEN 8 THEN '- **总分**: ' || score || '/100' WHEN 9 THEN '- **评级**: ' || CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 80 THEN 'WARNING' ELSE 'PASS' END WHEN 10 THEN '- **问题总数**: ' || (c + w + i)
  WHEN 12 THEN '## 问题统计' WHEN 13 THEN '- **Critical (严重)**: ' || c WHEN 14 THEN '- **Warning (警告)**: ' || w WHEN 15 THEN '- **Info (提示)**: ' || i
  WHEN 17 THEN '## 评分说明' WHEN 18 THEN '本系统采用非线性扣分机制，避免单一类问题导致分数过低：' WHEN 19 THEN '- **Critical**: 权重 5 (线性扣分)' WHEN 20 THEN '- **Warning**: 权重 2 (平方根非线性扣分)' WHEN 21 THEN '- **Info**: 权重 0.5 (平方根非线性扣分)'
  WHEN 23 THEN '**总扣分计算**: `5 * ' || c || ' + 2 * sqrt(' || w || ') + 0.5 * sqrt(' || i || ')` ≈ `' || printf('%.2f', loss) || '`' WHEN 24 THEN '**最终得分**: `100 - ' || CAST(round_even(loss, 0) AS BIGINT) || '` = `' || score || '`' ELSE '' END AS line
  FROM (SELECT *, 5.0 * c + 2.0 * sqrt(w) + 0.5 * sqrt(i) AS loss, unnest(range(1, 25)) AS n FROM (SELECT doc_id, coalesce(c, 0) AS c, coalesce(w, 0) AS w, coalesce(i, 0) AS i, {_score} AS score FROM documents LEFT JOIN cs USING (doc_id)))"""),
    "ingest_report": over(ASKED_LINES, f"""SELECT doc_id, doc_id % 5 = 3 AS encrypted, coalesce(pages, 0) AS pages, coalesce(scanned, 0) AS scanned_pages, CAST(0 AS BIGINT) AS multi_column_pages FROM documents LEFT JOIN (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE n < 10) AS scanned FROM (SELECT doc_id, length({strip('string_agg(' + strip('content') + chr(44) + chr(39) * 2 + ' ORDER BY line_no)')}) AS n FROM lines GROUP BY doc_id, page_num) GROUP BY doc_id) USING (doc_id)"""),
    "audit_payloads": over(f"{ISSUES.replace(LINES, ASKED_LINES)}, {COUNTS}, {TAGS}", f"""SELECT doc_id, CAST(coalesce(c + w + i, 0) AS BIGINT) AS n_issues, coalesce(c, 0) AS n_critical, coalesce(w, 0) AS n_warning, coalesce(i, 0) AS n_info, {_score} AS score, CASE WHEN {_score} < 60 THEN 'Critical' WHEN {_score} < 80 THEN 'Warning' ELSE 'Info' END AS audit_level, coalesce(tags, '') AS tags,
  coalesce(pages, 0) AS pages, coalesce(scanned_pages, 0) AS scanned_pages, CASE doc_id % 5 WHEN 3 THEN 'encrypted_pdf' WHEN 4 THEN 'invalid_pdf' END AS error FROM documents LEFT JOIN cs USING (doc_id) LEFT JOIN tg USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE n < 10) AS scanned_pages FROM (SELECT doc_id, length({strip('string_agg(' + strip('content') + chr(44) + chr(39) * 2 + ' ORDER BY line_no)')}) AS n FROM lines GROUP BY doc_id, page_num) GROUP BY doc_id) USING (doc_id)"""),
    "tags": over(f"{ISSUES}, {TAGS}", "SELECT doc_id, coalesce(tags, '') AS tags FROM tg"),
    "audit_report": over(f"{ISSUES}, {COUNTS}, {TAGS}", f"SELECT doc_id, CAST(coalesce(c + w + i, 0) AS BIGINT) AS n_issues, coalesce(c, 0) AS n_critical, coalesce(w, 0) AS n_warning, coalesce(i, 0) AS n_info, {_score} AS score, CASE WHEN {_score} < 60 THEN 'Critical' WHEN {_score} < 80 THEN 'Warning' ELSE 'Info' END AS audit_level, coalesce(tags, '') AS tags FROM documents LEFT JOIN cs USING (doc_id) LEFT JOIN tg USING (doc_id)"),
    "anchor_ids": over(on(LABELS), "SELECT DISTINCT doc_id, md5('Label_Missing-' || page_num || '-[' || printf('%.1f, %.1f, %.1f, %.1f', x0, y0, x1, y1) || ']') AS anchor_id FROM labels JOIN elements USING (doc_id, seq, page_num, content)"),
    "top3_per_type": over(on(POSITIONS), "SELECT doc_id, seq, hit AS evidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, hit) AS rank FROM ps) WHERE rank <= 3"),
    "prf1": "SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT lang, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn FROM (SELECT doc_id, lang, n_chars < 300 AS p, quality = 0 AS t FROM documents JOIN labels USING (doc_id)) GROUP BY lang)",
    "knn_cosine_topk": "SELECT vec_id, distance FROM (SELECT e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY distance, vec_id LIMIT 5",
    "knn_exact": "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0 AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10",
    "knn_filtered": "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0 AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.label = 1)) WHERE rank <= 5",
    "expert_filter_search": "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%trash%' OR lang ILIKE '%trash%' OR source ILIKE '%trash%' ORDER BY doc_id DESC LIMIT 50",
    "vector_dim_check": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 64 THEN 'ok' ELSE CAST(len(embedding) AS VARCHAR) END AS status FROM embeddings) GROUP BY status",
    "pad_embedding": "SELECT vec_id, 768 AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "fact_points": f"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(substr({strip('text')}, 1, 12000), '[。！？\n]+'), lambda p: substr(regexp_replace({strip('p')}, {q(P.S + '+')}, ' ', 'g'), 1, 30)), lambda p: p <> '')[:12], lambda p: '- ' || p), chr(10)) AS facts FROM documents",
    "llm_response_parse": "SELECT doc_id, CAST(0 AS BIGINT) AS pos, CASE WHEN doc_id % 3 = 2 THEN 'Citation_Layout_Check' ELSE 'Terminology_Language' END AS issue_type, CASE WHEN doc_id % 3 = 2 THEN 'Info' ELSE 'Warning' END AS severity, '[' || doc_id || ']' AS evidence FROM documents WHERE doc_id % 3 <> 1",
    "mock_scan": "WITH t AS (SELECT conv_id, concat_ws(' ', text, concat_ws(' ', CASE WHEN conv_id % 2 = 0 THEN 'e.g.' END, CASE WHEN conv_id % 3 = 0 THEN 'LLM' END)) AS text FROM conversations) SELECT conv_id AS doc_id, 'Abbreviation_Definition' AS issue_type, 'Info' AS severity, 'e.g.' AS evidence FROM t WHERE contains(text, 'e.g.') UNION ALL SELECT conv_id, 'Terminology_Inconsistency', 'Info', 'LLM' FROM t WHERE contains(text, 'LLM') AND NOT contains(text, 'Large Language Model')",
    "content_fallback": "SELECT CAST(o_custkey AS VARCHAR) AS paper_id, CAST(o_orderkey AS VARCHAR) AS chunk_id, content FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'body ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'text ' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'review ' || o_orderkey END AS content FROM orders) WHERE content IS NOT NULL",
    "latest_task": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "upsert_merge": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer UNION ALL SELECT -c_custkey, 'new', -1 FROM customer WHERE c_custkey % 10 = 1",
    "bucketed_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'second' WHEN c_custkey % 4 = 0 THEN 'first' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, c_acctbal FROM customer UNION ALL SELECT -c_custkey, 'new', NULL, NULL FROM customer WHERE c_custkey % 10 = 1",
    "rule_overlay": "SELECT CAST(coalesce(a.n_nationkey, b.k) AS VARCHAR) AS rule_id, coalesce(b.content, a.n_name) AS content, CASE WHEN b.k IS NULL THEN 'yaml' ELSE 'db' END AS source FROM nation a FULL JOIN (SELECT n_nationkey + 5 AS k, 'db ' || n_name AS content FROM nation WHERE n_nationkey % 2 = 0) b ON a.n_nationkey = b.k",
    "ground_truth_upsert": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.severity, a.severity) AS severity, coalesce(CASE WHEN b.message <> '' THEN b.message END, a.message) AS message FROM (SELECT doc_id, 'Info' AS severity, 'old ' || lang AS message FROM documents) a FULL JOIN (SELECT doc_id + 10 AS doc_id, 'Warning' AS severity, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS message FROM labels) b ON a.doc_id = b.doc_id",
    "seed_rules": "SELECT count(*) FILTER (WHERE NOT there) AS inserted, 0::BIGINT AS updated, count(*) FILTER (WHERE there) AS skipped FROM (SELECT n_nationkey + 10 IN (SELECT n_nationkey FROM nation) AS there FROM nation)",
    "block_explode": "SELECT doc_id, page_num, line_no, 'L' || line_no AS content FROM (SELECT doc_id, CAST(1 AS INTEGER) AS page_num, unnest([1, 2, 3]) AS line_no FROM documents)",
    "windowed_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "result_rows": over(on(LABELS), "SELECT doc_id, printf('item-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY seq)) AS result_id, 'FMT-003' AS rule_id, 1 AS score, 'p' || page_num AS section, CAST(y0 AS INTEGER) AS line_start FROM (SELECT DISTINCT doc_id, seq, page_num, content FROM labels) JOIN elements USING (doc_id, seq, page_num, content)"),
}
