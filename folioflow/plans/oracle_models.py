"""DuckDB SQL for the queries over formulas, answers, models, rasters and sinks."""

from __future__ import annotations

from .oracle import _CHUNK_ID, _FAKE_MARK, _PICTURES, _STATS0, _needs, _with

_RAW = r"""CASE seq % 4 WHEN 0 THEN '\[ x \] и \( y \) ' WHEN 1 THEN '\\[a  b\\]  и  \\( c\\)' WHEN 2 THEN '$ x  y $ $$ z $$   ' ELSE '  ' END || text"""
_MARKS = rf"""regexp_replace(regexp_replace({_RAW}, '\\{{1,2}}[\[\]]', '$$', 'g'), '\\{{1,2}}[()]', '$', 'g')"""
_TIDY = rf"""trim(regexp_replace(regexp_replace(regexp_replace({_MARKS}, '(?s)\$\$\s*(.*?)\s*\$\$', '$$\1$$', 'g'), '(?s)\$\s*(.*?)\s*\$', '$\1$', 'g'), '([^\n]) {{2,}}', '\1 ', 'g'), E' \t\r\n')"""

#: A word that may belong to a formula: up to five Latin letters, or any with a mathematical sign; no full stop.
_MATHS = r"(?:[A-Za-z]{1,5}|[^\s,.!?]*[_^0-9=+\-*/<>\\{}\[\]][^\s,.!?]*)"
_BARE = r"""translate(text, '$\()[]{}"', '')"""


def _onto(t: str, formula: str) -> str:
    """``t``, a blank and a formula in dollars, which takes in the mathematical words right before it."""
    tail = rf"regexp_extract({t} || ' ', '(?:^|[\s,])((?:{_MATHS}[ ,]+)+|[ ,]*)$', 1)"
    words = f"(CASE WHEN regexp_matches({tail}, '[^ ,]') THEN ltrim({tail}, ' ,') ELSE '' END)"
    return f"(substr({t} || ' ', 1, length({t}) + 1 - length({words})) || '$' || {words} || '{formula}$')"


def _wrapped(t: str) -> str:
    lead = rf"regexp_extract(', ' || {t}, '^((?:[ ,]+{_MATHS})*)(?:[\s,]|$)', 1)"
    return rf"""CASE seq % 4 WHEN 1 THEN {_onto(t, r"\\alpha + x")} WHEN 3 THEN {_onto(t, r"\\beta(z слово)")} || ' дальше'
WHEN 2 THEN '$x_1' || {lead} || '$' || substr(', ' || {t}, length({lead}) + 1) ELSE {t} END"""


_N = "nabla|natural|ne|ni|noalign|nocite|nofiles|noindent|nolinebreak|nolimits|nonumber|nonfrenchspacing|nonstopmode|nopagebreak|normal|not|nu|numberline|nwarrow"
#: Slashes as signs of their own: 2 for two of them, 1 for one; then 5, 3, 4 for what becomes four, two, one.
_SIGNS = r"replace(regexp_replace(t, '\\{2,}', chr(2), 'g'), '\', chr(1))"
_ESCAPED = (
    rf"regexp_replace({_SIGNS}, '\x02(\s)', chr(5) || '\1', 'g')", rf"regexp_replace({{0}}, '[\x01\x02]({_N})', chr(3) || '\1', 'g')", r'''regexp_replace({0}, '[\x01\x02](["''n])', chr(4) || '\1', 'g')''',
    r"replace(replace(replace(replace(replace({0}, chr(1), '\\'), chr(2), '\\'), chr(3), '\\'), chr(4), '\'), chr(5), '\\\\')",
)
_escape = _ESCAPED[0]
for _step in _ESCAPED[1:]:
    _escape = _step.replace("{0}", _escape)

_GEOMETRY = """SELECT {more} {width} FROM (SELECT *, greatest(hh, {low}) AS height, CASE WHEN hh < {low} THEN CAST(floor(({low} - hh) / 2) AS INTEGER) ELSE 0 END AS pad_top FROM (
  SELECT *, least(w, {cap}) AS width, CASE WHEN w > {cap} THEN CAST(floor(h::DOUBLE * ({cap}::DOUBLE / w::DOUBLE)) AS INTEGER) ELSE h END AS hh FROM (
    SELECT *, CAST(ceil(x1 - 0.001) AS INTEGER) - l AS w, CAST(ceil(y1 - 0.001) AS INTEGER) - t AS h FROM (SELECT *, CAST(floor(x0 + 0.001) AS INTEGER) AS l, CAST(floor(y0 + 0.001) AS INTEGER) AS t FROM (
      SELECT *, x * z AS x0, y * z AS y0, (x + 50 + seq * 37 % 600) * z AS x1, (y + 5 + seq % 60) * z AS y1 FROM (SELECT *, (seq % 7 * 10.5)::DOUBLE AS x, (seq * 3 % 500 + 0.25)::DOUBLE AS y, 150::DOUBLE / 72::DOUBLE AS z FROM parsed WHERE {where}))))))"""
_DRAWN = "doc_id, seq, 'chunk' || chunk_id || '_' || doc_id || '{0}.png' AS file, l AS \"left\", t AS top, w AS drawn_width, h AS drawn_height,"

_FIXED = r"replace(t, '\alpha', 'alpha')"
_WORK = f"(SELECT *, {_needs('t')} AS w FROM (SELECT *, {_FAKE_MARK} AS t FROM parsed))"
_TEXT_STATS = f"""SELECT doc_id, count(*) FILTER (w) AS total_chunks_checked, count(*) FILTER (w AND length(t) % 5 <> 0 AND {_FIXED} <> t) AS total_corrected, count(*) FILTER (w AND length(t) % 5 = 0) AS total_failed,
coalesce(string_agg(CASE WHEN w AND length(t) % 5 = 0 THEN chunk_id END, ',' ORDER BY chunk_id), '') AS failed_chunks FROM {_WORK} GROUP BY doc_id"""


def _image_stats(text: str) -> str:
    return f"""SELECT doc_id, count(*) FILTER (im) AS total_images, count(*) FILTER (im AND length(t) % 3 <> 0) AS described_images, count(*) FILTER (im AND length(t) % 3 = 0) AS failed_images,
coalesce(string_agg(CASE WHEN im AND length(t) % 3 = 0 THEN chunk_id END, ',' ORDER BY chunk_id), '') AS failed_chunks FROM (SELECT doc_id, chunk_id, {text} AS t, block_type IN {_PICTURES} AS im FROM parsed) GROUP BY doc_id"""


_FIGURES = ("total_chunks_checked", "total_corrected", "total_failed", "total_images", "described_images", "failed_images")

ORACLE_SQL: dict[str, str] = {
    "fn1_clean_answers": _with("SELECT doc_id, seq, " + _wrapped("b") + rf" AS text FROM (SELECT doc_id, seq, trim(regexp_replace({_BARE}, '([^\n]) {{2,}}', '\1 ', 'g'), E' \t\r\n') AS b FROM parsed)", "parsed"),
    "fn3_tidy_delimiters": _with(f"SELECT doc_id, seq, {_TIDY} AS text FROM parsed", "parsed"),
    "fn4_escape": _with(
        f"SELECT doc_id, seq, {_escape} AS text FROM (SELECT doc_id, seq, {_BARE} || " + r"""CASE seq % 5 WHEN 0 THEN ' \alpha x' WHEN 1 THEN ' \\beta \\\\\gamma;' WHEN 2 THEN ' a \\ b \n c \nu \\new' WHEN 3 THEN ' \"q\\'' \{z' ELSE '' END AS t FROM parsed)""", "parsed"),
    "fn5_wrap_formulas": _with(f"SELECT doc_id, seq, {_wrapped(_BARE)} AS text FROM parsed", "parsed"),
    "fn9_formulas_valid": r"""WITH f AS (SELECT doc_id, unnest(CASE doc_id % 6 WHEN 0 THEN ['x^{2}', '\{a\}'] WHEN 1 THEN ['\frac{a}{b'] WHEN 2 THEN ['\left( x'] WHEN 3 THEN ['\begin{m} a \end{m}', '\left(x\right)'] WHEN 4 THEN ['\begin{m} a \end{k}'] ELSE ['}{'] END) AS x, text IS NULL AS gone FROM documents),
g AS (SELECT doc_id, gone, regexp_extract_all(x, '\\begin\{(\w+)\}', 1) AS b, regexp_extract_all(x, '\\end\{(\w+)\}', 1) AS e, len(regexp_extract_all(x, '\\left[^a-z]')) AS l, len(regexp_extract_all(x, '\\right[^a-z]')) AS r,
  regexp_replace(regexp_replace(regexp_replace(x, '\\[{}]', '', 'g'), '\{[^{}]*\}', '', 'g'), '\{[^{}]*\}', '', 'g') AS rest FROM f)
SELECT doc_id, CASE WHEN bool_or(gone) THEN NULL ELSE bool_and(b = e AND l = r AND NOT regexp_matches(rest, '[{}]')) END AS valid FROM g GROUP BY doc_id""",
    "prj3_math_blocks": _with(
        r"""SELECT doc_id, seq, translate(text, '<>&', '') || ' ' || CASE seq % 4 WHEN 0 THEN '$' || trim(replace(replace(' x &lt; \\alpha ', '&lt;', '<'), '\\', '\')) || '$'
  WHEN 1 THEN '$$' || replace(replace(replace(replace('a \\ \begin{b} &amp; \\end', '&amp;', '&'), '\\ \begin', chr(1)), '\\', '\'), chr(1), '\\ \begin') || '$$' WHEN 2 THEN '$' || replace(replace('a\\\\b', '\\\\', chr(1)), chr(1), '\\\') || '$ и $$c$$' ELSE 'y' END AS text FROM blocks""", "blocks"),
    "prj5_html_text": r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g'),
'&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') AS text FROM pages""",
    "prj7_repair_encoding": r"""SELECT doc_id, nfc_normalize(regexp_replace(replace(replace(translate(replace(replace(replace(text || CASE doc_id % 4 WHEN 0 THEN ' café да' WHEN 1 THEN ' “q” ‘r’ ﬁn ﬂ' WHEN 2 THEN chr(13) || chr(10) || 'x' || chr(1) || chr(13) || 'y' ELSE ' e' || chr(769) END,
  chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(133), chr(10)), '‘’‚“”„', repeat(chr(39), 3) || repeat(chr(34), 3)), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\x00-\x08\x0b\x0e-\x1f\x7f]', '', 'g')) AS text FROM documents""",
    "mdl9_dense_vectors": r"SELECT doc_id, 384 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "src1_layout_scan": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, seq, '/page/' || (seq // 8) || '/Text/' || seq AS block_path, 'Text' AS block_type, CAST(seq // 8 AS VARCHAR) AS page, '0,' || 12 * seq || ',500,' || (12 * seq + 10) AS bbox, '<p>' || line || '</p>' AS html FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS INTEGER) AS seq FROM documents)""",
    "src5_parent_scan": _with(
        """SELECT doc_id, seq, chunk_id, block_type, parent_group, section_path, coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT f.label || '=' || array_to_string(a.chunk_ids, ',') AS e
  FROM firsts f JOIN anchors a ON a.doc_id = f.doc_id AND a.label = f.label WHERE f.doc_id = g.doc_id AND f.seq = g.seq)), '') AS linked_chunks FROM grouped g""", "grouped", "firsts", "anchors"),
    "src6_region_rasters": _with(_GEOMETRY.format(more=_DRAWN.format(""), cap=600, low=32, where="true", width="width, height, pad_top"), "parsed"),
    "src7_drawn_regions": _with(_GEOMETRY.format(more=_DRAWN.format("_image"), cap=1_000_000, low=0, where=f"block_type IN {_PICTURES}", width="width, height, pad_top"), "parsed"),
    "src8_record_images": _with(_GEOMETRY.format(more=f"{_CHUNK_ID} || '.png' AS file,", cap=600, low=32, where="block_type IN ('PictureGroup', 'FigureGroup')", width="width, height"), "parsed"),
    "jn6_page_regions": _with("SELECT doc_id, string_agg(seq || ':' || CAST(page AS INTEGER), ',' ORDER BY seq) AS regions FROM parsed GROUP BY doc_id", "parsed"),
    "snk7_upsert": "SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN upper(c_name) ELSE c_name END AS name, c_nationkey AS nation FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey FROM customer WHERE c_nationkey = 7",
    "mdl1_repaired_texts": _with(f"SELECT doc_id, seq, CASE WHEN w AND length(t) % 5 <> 0 THEN {_FIXED} ELSE t END AS text, w AND length(t) % 5 <> 0 AS fixed FROM (SELECT *, {_needs('t')} AS w FROM (SELECT *, translate({_FAKE_MARK}, '$', '') AS t FROM parsed WHERE block_type = 'Text'))", "parsed"),
    "mdl2_described_images": _with(f"SELECT doc_id, seq, CASE WHEN length(text) % 3 <> 0 THEN '![диаграмма][' || text || '](Схема, на которой вершины соединены рёбрами; подпись дана в тексте.. Ключевые слова: схема)' ELSE text END AS text, length(text) % 3 <> 0 AS described FROM parsed WHERE block_type IN {_PICTURES}", "parsed"),
    "mdl4_parameters": _with(f"SELECT text, count(*) AS n FROM (SELECT 'm 0.25 1.5 77 P' AS text, w FROM {_WORK}) WHERE w GROUP BY text", "parsed"),
    "mdl5_image_prompts": _with(
        f"""SELECT doc_id, seq, text || '. Текст рядом: До изображения:' || chr(10) || before || chr(10) || 'После изображения:' || chr(10) || after || '. Ответ: {{"description": "...", "image_type": "...", "key_elements": ["..."]}}' AS asked
FROM (SELECT *, lag(text, 1, '') OVER w AS before, lead(text, 1, '') OVER w AS after FROM parsed WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE block_type IN {_PICTURES}""", "parsed"),
    "mdl7_descriptions_in_order": _with(
        f"""SELECT doc_id, seq, '![' || CASE WHEN coalesce(before, false) THEN 'дерево' ELSE 'диаграмма' END || '][' || text || '](Ещё один рисунок с вершинами и рёбрами, описанный достаточно длинно.)' AS text
FROM (SELECT *, lag(image) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM (SELECT *, block_type IN {_PICTURES} OR seq % 20 = 13 AS image FROM parsed)) WHERE image""", "parsed"),
    "agg8_text_stats": _with(f"SELECT * FROM ({_TEXT_STATS})", "parsed"),
    "agg9_image_stats": _with(f"SELECT * FROM ({_image_stats('text')})", "parsed"),
    "agg10_document_stats": _with(
        f"""SELECT s.*, 'done' AS marker_status, 'done' AS text_status, 'done' AS image_status, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _FIGURES)}
FROM ({_STATS0} FROM blocks b GROUP BY doc_id) s LEFT JOIN ({_TEXT_STATS}) t ON t.doc_id = s.doc_id LEFT JOIN ({_image_stats(_FAKE_MARK)}) i ON i.doc_id = s.doc_id""", "blocks", "parsed"),
}
