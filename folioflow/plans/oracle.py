"""DuckDB SQL for the queries: an independent statement of what they return, built from shared common tables."""

from __future__ import annotations

# Fixed values, stated here once more so that the SQL does not lean on the library's lists: kinds of labelled passages; what ends one;
# word forms in references, the strict and the fuller ones; the noun that each stem stands for.
LABEL_KINDS = ("определение", "теорема", "лемма", "аксиома", "следствие", "утверждение", "замечание", "пример", "алгоритм", "задача", "свойство", "доказательство")
STOP_WORDS = ("доказательство", "заметим", "покажем", "таким образом", "следовательно", "отсюда", "действительно", "вернёмся", "перейдём", "рассмотрим", "во многих", "многие")
REFERENCE_FORMS = (
    "определени[иею]", "теорем[еаы]", "лемм[еаы]", "аксиом[еаы]", "следстви[иею]", "утвержден[ии]", "замечани[иею]", "примере?", "алгоритм[еа]", "задач[еи]", "свойств[еа]",
    "доказательств[еа]", r"рис(?:унк[еа])?\.?",
)
EXTENDED_FORMS = (
    "определени[иеюя]", "теорем[еаыу]", "лемм[еаыу]", "аксиом[еаыу]", "следстви[иеюя]", "утверждени[иеюя]", "замечани[иеюя]", "пример[ау]?е?", "алгоритм[еау]?", "задач[еиау]", "свойств[еау]",
    "доказательств[еау]", r"рис(?:ун(?:ок|к[еау]))?\.?",
)
REFERENCE_NOUNS = (
    ("определени", "Определение"), ("теорем", "Теорема"), ("лемм", "Лемма"), ("аксиом", "Аксиома"), ("следстви", "Следствие"), ("утвержден", "Утверждение"), ("замечани", "Замечание"), ("пример", "Пример"),
    ("алгоритм", "Алгоритм"), ("задач", "Задача"), ("свойств", "Свойство"), ("доказательств", "Доказательство"), ("рис", "Рисунок"),
)

_CHAIN = {
    "blocks": """SELECT doc_id, seq, '/page/' || page || '/' || block_type || '/' || seq AS block_path, block_type, page, text FROM (
  SELECT doc_id, seq, CAST(seq // 8 AS VARCHAR) AS page,
    CASE WHEN m = 1 THEN 'SectionHeader' WHEN m = 7 THEN 'PageFooter' WHEN m = 8 THEN 'Equation' WHEN m = 12 THEN 'FigureGroup'
      WHEN m IN (15, 17) AND doc_id % 3 = 0 THEN 'SectionHeader' ELSE 'Text' END AS block_type,
    CASE WHEN m = 1 THEN n || CASE c % 3 WHEN 0 THEN ' ' WHEN 1 THEN '.1 ' ELSE '.1.1 ' END || line
      WHEN m = 2 THEN 'Определение ' || n || '. ' || line WHEN m = 5 THEN 'Теорема ' || n || '. ' || line
      WHEN m = 9 THEN line || ' по теореме ' || n || ' и лемме ' || (c + 7) WHEN m = 10 THEN 'Рассмотрим ' || line
      WHEN m = 12 THEN 'рис. ' || n || ' ' || line WHEN m = 15 AND doc_id % 3 = 0 THEN 'Упражнения'
      WHEN m = 17 AND doc_id % 3 = 0 THEN 'Задача ' || n ELSE line END AS text
  FROM (SELECT doc_id, line, seq, seq % 20 AS m, seq // 20 AS c, CAST(seq // 20 + 1 AS VARCHAR) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq FROM documents)))""",
    "region": r"""SELECT *, coalesce(state AND (NOT head OR item), false) AS skipped FROM (
  SELECT *, last_value(CASE WHEN opens THEN true WHEN head AND NOT item THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
  FROM (SELECT *, block_type = 'SectionHeader' AS head,
      block_type = 'SectionHeader' AND regexp_matches(trim(text), '^(Задача|Упражнение)\s*\d+') AS item,
      block_type = 'SectionHeader' AND (contains(text, 'Задачи') OR contains(text, 'Упражнения')) AND length(text) <= 15 AS opens FROM blocks))""",
    "parsed": """SELECT doc_id, seq, block_type, page, text, page || '-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS VARCHAR) AS chunk_id FROM (
  SELECT * REPLACE (CASE WHEN block_type IN ('Equation', 'Code') THEN '$$' || text || '$$' ELSE text END AS text) FROM region
  WHERE NOT skipped AND NOT opens AND block_type NOT IN ('PageHeader', 'PageFooter', 'Footnote')) WHERE length(text) > 3""",
    "heads": r"""SELECT *, CASE WHEN sec THEN len(string_split(num, '.')) END AS depth, CASE WHEN sec THEN trim(regexp_replace(trim(text), '^[\d.]+\s*', '')) END AS title FROM (
  SELECT *, block_type = 'SectionHeader' AND regexp_matches(trim(text), '^\d+(\.\d+)*\.?\s+\S') AS sec, regexp_extract(trim(text), '^(\d+(\.\d+)*)', 1) AS num FROM parsed)""",
    "secs": """SELECT doc_id, seq, CASE WHEN block_type = 'SectionHeader' AND depth IS NULL THEN 'Text' ELSE block_type END AS block_type, page, text, chunk_id,
  concat_ws(' > ', CASE WHEN p1 >= 0 THEN t1 END, CASE WHEN p2 > p1 THEN t2 END, CASE WHEN p3 > greatest(p1, p2) THEN t3 END) AS section_path
FROM (SELECT *, """
    + ", ".join(f"coalesce(last_value(CASE WHEN depth = {d} THEN seq END IGNORE NULLS) OVER w, -1) AS p{d}, last_value(CASE WHEN depth = {d} THEN title END IGNORE NULLS) OVER w AS t{d}" for d in (1, 2, 3))
    + " FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "labelled": rf"""SELECT doc_id, seq, block_type, page, text, chunk_id, section_path, CASE WHEN block_type IN ('PictureGroup', 'FigureGroup') THEN CASE WHEN fig <> '' THEN 'Рисунок ' || fig ELSE '' END
    WHEN block_type = 'Text' AND e.lab IS NOT NULL AND rn - e.rn <= 6 THEN e.lab ELSE '' END AS content_label
FROM (SELECT *, last_value(CASE WHEN lab IS NOT NULL OR ends THEN {{'rn': rn, 'lab': lab}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn, block_type <> 'Text' OR regexp_matches(trim(text), '(?i)^({"|".join(STOP_WORDS)})') AS ends,
    regexp_extract(text, '(?i)рис(?:унок)?\.?\s*(\d+(?:\.\d+)*)', 1) AS fig,
    CASE WHEN block_type = 'Text' AND regexp_matches(trim(text), '(?i)^({"|".join(LABEL_KINDS)})[\s\x{{A0}}]+\d')
      THEN upper(substr(k, 1, 1)) || lower(substr(k, 2)) || ' ' || regexp_extract(trim(text), '(?i)^(?:{"|".join(LABEL_KINDS)})[\s\x{{A0}}]+(\d+(?:\.\d+)*)', 1) END AS lab
    FROM (SELECT *, regexp_extract(trim(text), '(?i)^({"|".join(LABEL_KINDS)})[\s\x{{A0}}]+\d', 1) AS k FROM secs)))""",
    "anchors": "SELECT doc_id, content_label AS label, list(chunk_id ORDER BY seq) AS chunk_ids FROM labelled WHERE content_label <> '' GROUP BY doc_id, content_label",
}


def _refs(forms: tuple[str, ...]) -> str:
    found = rf"'(?i)(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(forms)})[\s\x{{A0}}]+(\d+(?:\.\d+)*)'"
    noun = " ".join(f"WHEN starts_with(k, '{p}') THEN '{n}'" for p, n in REFERENCE_NOUNS)
    return f"""SELECT doc_id, seq, chunk_id, pos, label FROM (SELECT doc_id, seq, chunk_id, content_label, pos, CASE {noun} END || ' ' || num AS label FROM (
  SELECT doc_id, seq, chunk_id, content_label, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, lower(unnest(a)) AS k, unnest(b) AS num FROM (
    SELECT *, regexp_extract_all(text, {found}, 1) AS a, regexp_extract_all(text, {found}, 2) AS b FROM labelled))) WHERE label <> content_label"""


_CHAIN["refs"] = _refs(REFERENCE_FORMS)
_CHAIN["firsts"] = "SELECT doc_id, seq, chunk_id, label, min(pos) AS pos FROM refs GROUP BY ALL"
_CHAIN["body"] = "SELECT doc_id, seq, chunk_id, section_path AS p, content_label AS l, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM labelled WHERE block_type <> 'SectionHeader'"
# One step of the packing rule a level of recursion, all documents at once. g: group number, n: its size, b: run's size, r: run's number.
_CHAIN["fold"] = """SELECT doc_id, 0::BIGINT AS rn, NULL::VARCHAR AS p, NULL::VARCHAR AS lab, 0 AS g, 0 AS n, 0 AS b, 0 AS r, NULL::INTEGER AS own, NULL::INTEGER AS run, NULL::INTEGER AS moved, NULL::INTEGER AS into_g
FROM (SELECT DISTINCT doc_id FROM body)
UNION ALL
SELECT doc_id, rn, p, lab, CASE WHEN n >= 10 THEN g + 1 ELSE g END, CASE WHEN n >= 10 THEN 0 ELSE n END, b, r, own, run, moved, into_g FROM (
  SELECT doc_id, rn, p, CASE WHEN l = '' THEN NULL ELSE l END AS lab, g, CASE WHEN l = '' THEN n + 1 ELSE n END AS n,
    CASE WHEN l = '' THEN 0 WHEN same THEN b + 1 ELSE 1 END AS b, CASE WHEN l <> '' AND b = 0 THEN r + 1 ELSE r END AS r,
    CASE WHEN l = '' THEN g END AS own, CASE WHEN l <> '' THEN CASE WHEN b = 0 THEN r + 1 ELSE r END END AS run, moved, into_g FROM (
    SELECT doc_id, rn, p, l, same, r, CASE WHEN turn THEN CASE WHEN n2 > 0 THEN g2 + 1 ELSE g2 END ELSE g2 END AS g, CASE WHEN turn THEN 0 ELSE n2 END AS n, CASE WHEN mv THEN 0 ELSE b END AS b,
      CASE WHEN mv AND b > 0 THEN r END AS moved, CASE WHEN mv AND b > 0 THEN g2 END AS into_g FROM (
      SELECT *, CASE WHEN over THEN g + 1 ELSE g END AS g2, CASE WHEN mv AND b > 0 THEN CASE WHEN over THEN b ELSE n + b END ELSE n END AS n2 FROM (
        SELECT *, mv AND b > 0 AND n > 0 AND n + b > 10 AS over FROM (
          SELECT x.doc_id, x.rn, x.p, x.l, f.g, f.n, f.b, f.r, f.p IS NOT NULL AND f.p <> x.p AS turn, x.l <> '' AND f.lab IS NOT NULL AND x.l = f.lab AS same,
            (f.p IS NOT NULL AND f.p <> x.p) OR NOT (x.l <> '' AND f.lab IS NOT NULL AND x.l = f.lab) AS mv
          FROM fold f JOIN body x ON x.doc_id = f.doc_id AND x.rn = f.rn + 1)))))"""
_CHAIN["runs"] = """SELECT doc_id, moved AS run, into_g FROM fold WHERE moved IS NOT NULL
UNION ALL SELECT doc_id, r, CASE WHEN n > 0 AND n + b > 10 THEN g + 1 ELSE g END FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn DESC) AS z FROM fold) WHERE z = 1 AND b > 0"""
_CHAIN["grouped"] = """SELECT l.*, CAST(coalesce(f.own, r.into_g) AS VARCHAR) AS parent_group FROM labelled l JOIN body b USING (doc_id, seq) JOIN fold f ON f.doc_id = b.doc_id AND f.rn = b.rn
LEFT JOIN runs r ON r.doc_id = f.doc_id AND r.run = f.run"""
_CHAIN["links"] = """SELECT g.doc_id, g.seq, g.chunk_id, g.parent_group, f.label, f.pos, CAST(generate_subscripts(a.chunk_ids, 1) - 1 AS INTEGER) AS place, unnest(a.chunk_ids) AS target
FROM grouped g JOIN firsts f USING (doc_id, seq) JOIN anchors a ON a.doc_id = f.doc_id AND a.label = f.label"""
_CHAIN["sided"] = "SELECT k.*, h.parent_group IS DISTINCT FROM k.parent_group AS external FROM links k LEFT JOIN grouped h ON h.doc_id = k.doc_id AND h.chunk_id = k.target"

_NEEDS = {
    "blocks": (), "region": ("blocks",), "parsed": ("region",), "heads": ("parsed",), "secs": ("heads",), "labelled": ("secs",), "anchors": ("labelled",), "refs": ("labelled",), "firsts": ("refs",),
    "body": ("labelled",), "fold": ("body",), "runs": ("fold",), "grouped": ("labelled", "body", "fold", "runs"), "links": ("grouped", "firsts", "anchors"), "sided": ("links", "grouped"),
}


def _with(select: str, *tables: str, **more: str) -> str:
    wanted: dict[str, None] = {}

    def add(t: str):
        for u in _NEEDS[t]:
            add(u)
        wanted.setdefault(t)

    for t in tables:
        add(t)
    parts = [f"{t} AS {'' if t == 'fold' else 'MATERIALIZED '}(\n{(_CHAIN | more)[t]})" for t in wanted]
    return f"WITH RECURSIVE {', '.join(parts)}\n{select}"


def _uuid(parts: str) -> str:
    return rf"regexp_replace(md5({parts}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


_CHUNK_ID = _uuid("'chunk' || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || chunk_id")
_PARENT_ID = _uuid("'parent' || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || parent_group")
_TARGET_ID = _uuid("'chunk' || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || target")
_SEARCH = "trim('Глава: ' || section_path || '. ' || text)"
_SIDE = "coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT label || '=' || string_agg({t}, ',' ORDER BY place) AS e FROM sided s WHERE s.doc_id = g.doc_id AND s.seq = g.seq AND {x} GROUP BY label)), '')"
_FAKE_MARK = "CASE WHEN seq % 7 = 1 THEN text || ' \\alpha' ELSE text END"
_PICTURES = "('Picture', 'Figure', 'FigureGroup', 'PictureGroup')"


def _needs(text: str) -> str:
    plain = rf"regexp_replace(regexp_replace({text}, '(?s)\$\$.*?\$\$|\$.*?\$', ' ', 'g'), '[-–—]', ' ', 'g')"
    return rf"(block_type NOT IN ('Picture', 'Figure', 'FigureGroup', 'PictureGroup', 'SectionHeader') AND (regexp_matches({text}, '\\+([a-zA-Z]+|\{{)') OR regexp_matches({plain}, '\p{{Cyrillic}}\S*\p{{Latin}}|\p{{Latin}}\S*\p{{Cyrillic}}')))"


_SENT = r"CASE seq % 7 WHEN 1 THEN text || ' \alpha' WHEN 2 THEN text || ' графG' WHEN 3 THEN text || ' $графG$' WHEN 4 THEN text || ' n-вершинный' ELSE text END"
_STATS0 = "SELECT doc_id, count(DISTINCT page) AS total_pages, (SELECT count(*) FROM parsed p WHERE p.doc_id = b.doc_id) AS total_chunks"

ORACLE_SQL: dict[str, str] = {
    "flagship_paths": _with("SELECT section_path, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM secs GROUP BY section_path", "secs"),
    "src_derived_blocks": _with("SELECT * FROM blocks", "blocks"),
    "prj1_page_from_path": _with("SELECT doc_id, seq, string_split(block_path, '/')[3] AS page FROM blocks", "blocks"),
    "win1_exercise_region": _with("SELECT doc_id, seq, opens, skipped FROM region", "region"),
    "flt_kept_chunks": _with("SELECT doc_id, seq, chunk_id, block_type, page, text FROM parsed", "parsed"),
    "agg7_parse_stats": _with(_STATS0 + " FROM blocks b GROUP BY doc_id", "blocks", "parsed"),
    "prj8_section_key": _with("SELECT doc_id, seq, num AS section_key, title AS section_title FROM heads WHERE sec", "heads"),
    "win2_section_path": _with("SELECT doc_id, seq, block_type, section_path FROM secs", "secs"),
    "win3_content_label": _with("SELECT doc_id, seq, content_label FROM labelled", "labelled"),
    "agg1_anchors": _with("SELECT doc_id, label, array_to_string(chunk_ids, ',') AS chunk_ids FROM anchors", "anchors"),
    "fn10_references": _with("SELECT doc_id, seq, chunk_id, pos, label FROM refs", "refs"),
    "prj13_reference_nouns": _with("SELECT label, count(*) AS n FROM refs GROUP BY label", "refs", refs=_refs(EXTENDED_FORMS)),
    "jn1_resolved": _with("SELECT doc_id, seq, chunk_id, label, pos, array_to_string(chunk_ids, ',') AS chunk_ids FROM firsts JOIN anchors USING (doc_id, label)", "firsts", "anchors"),
    "jn2_unresolved": _with("SELECT doc_id, seq, chunk_id, label, pos FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.doc_id = f.doc_id AND a.label = f.label)", "firsts", "anchors"),
    "agg2_linked_map": _with(
        "SELECT doc_id, seq, coalesce(string_agg(CASE WHEN chunk_ids IS NOT NULL THEN label || '=' || array_to_string(chunk_ids, ',') END, ';' ORDER BY label), '') AS linked_chunks, "
        "coalesce(string_agg(CASE WHEN chunk_ids IS NULL THEN label END, ',' ORDER BY pos), '') AS unresolved_refs FROM labelled LEFT JOIN firsts USING (doc_id, seq) LEFT JOIN anchors USING (doc_id, label) GROUP BY doc_id, seq", "firsts", "anchors"),
    "win5_parent_group": _with("SELECT doc_id, seq, chunk_id, parent_group FROM grouped", "grouped"),
    "agg3_parent_chunks": _with(
        """SELECT g.doc_id, g.parent_group AS id, arg_min(section_path, seq) AS section_path, string_agg(chunk_id, ',' ORDER BY seq) AS chunk_ids, CAST(count(*) AS INTEGER) AS mini_chunk_count,
coalesce((SELECT string_agg(l, ',' ORDER BY s) FROM (SELECT content_label AS l, min(seq) AS s FROM grouped h WHERE h.doc_id = g.doc_id AND h.parent_group = g.parent_group AND content_label <> '' GROUP BY content_label)), '') AS content_labels,
coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT DISTINCT f.label || '=' || array_to_string(a.chunk_ids, ',') AS e FROM grouped h JOIN firsts f ON f.doc_id = h.doc_id AND f.seq = h.seq JOIN anchors a ON a.doc_id = f.doc_id AND a.label = f.label
  WHERE h.doc_id = g.doc_id AND h.parent_group = g.parent_group AND NOT EXISTS (SELECT 1 FROM grouped i WHERE i.doc_id = h.doc_id AND i.parent_group = h.parent_group AND i.content_label = f.label))), '') AS linked_chunks,
coalesce((SELECT string_agg(l, ',' ORDER BY s, p) FROM (SELECT f.label AS l, min(f.seq) AS s, arg_min(f.pos, f.seq) AS p FROM grouped h JOIN firsts f ON f.doc_id = h.doc_id AND f.seq = h.seq LEFT JOIN anchors a ON a.doc_id = f.doc_id AND a.label = f.label
  WHERE a.label IS NULL AND h.doc_id = g.doc_id AND h.parent_group = g.parent_group GROUP BY f.label)), '') AS unresolved_refs
FROM grouped g GROUP BY g.doc_id, g.parent_group""", "grouped", "firsts", "anchors"),
    "agg11_chunk_stats": _with(
        """SELECT l.doc_id, count(*) AS total_chunks, (SELECT count(DISTINCT parent_group) FROM grouped g WHERE g.doc_id = l.doc_id) AS total_parent_chunks, (SELECT count(*) FROM grouped g WHERE g.doc_id = l.doc_id) AS total_final_chunks,
(SELECT count(*) FROM grouped g JOIN firsts f USING (doc_id, seq) LEFT JOIN anchors a ON a.doc_id = f.doc_id AND a.label = f.label WHERE a.label IS NULL AND g.doc_id = l.doc_id) AS unresolved_refs FROM labelled l GROUP BY l.doc_id""", "grouped", "firsts", "anchors"),
    "jn4_children_with_parents": _with("SELECT doc_id, parent_group, chunk_id, first_value(section_path) OVER w AS parent_path, CAST(count(*) OVER (PARTITION BY doc_id, parent_group) AS INTEGER) AS mini_chunk_count FROM grouped WINDOW w AS (PARTITION BY doc_id, parent_group ORDER BY seq)", "grouped"),
    "jn7_split_links": _with("SELECT doc_id, seq, chunk_id, label, place, target, external FROM sided", "sided"),
    "fn12_stable_ids": _with(f"SELECT doc_id, chunk_id, {_CHUNK_ID} AS id, {_PARENT_ID} AS parent_group_id FROM grouped", "grouped"),
    "prj14_storage_records": _with(
        f"""SELECT {_CHUNK_ID} AS id, page, (seq * 0 + 0.5) || ',' || (seq + 0.5) || ',' || (seq * 2 + 0.5) || ',' || (seq * 3 + 0.5) AS bbox, text, section_path, CAST(doc_id AS VARCHAR) || '.pdf' AS file_name, {_SEARCH} AS search_text, CASE WHEN block_type IN ('PictureGroup', 'FigureGroup') THEN 'picture' ELSE 'text' END AS type, {_PARENT_ID} AS parent_group_id,
{_SIDE.format(t=_TARGET_ID, x="external")} AS external_links, {_SIDE.format(t=_TARGET_ID, x="NOT external")} AS internal_links FROM grouped g""", "grouped", "sided"),
    "prj18_vector_documents": _with(f"SELECT {_CHUNK_ID} AS id, {_SEARCH} AS page_content, CASE WHEN block_type IN ('PictureGroup', 'FigureGroup') THEN 'picture' ELSE 'text' END AS type, section_path, {_PARENT_ID} AS parent_id, CAST(doc_id AS VARCHAR) AS file_name FROM grouped", "grouped"),
    "agg12_storage_stats": _with("SELECT CAST(doc_id AS VARCHAR) AS file_name, count(*) AS total_chunks FROM grouped GROUP BY doc_id", "grouped"),
    "win4_image_context": _with(f"SELECT doc_id, seq, context FROM (SELECT *, 'До изображения:' || chr(10) || lag(text, 1, '') OVER w || chr(10) || 'После изображения:' || chr(10) || lead(text, 1, '') OVER w AS context FROM parsed WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE block_type IN {_PICTURES}", "parsed"),
    "flt5_needs_text_work": _with(f"SELECT doc_id, seq, {_needs('t')} AS needs_work FROM (SELECT *, {_SENT} AS t FROM parsed)", "parsed"),
    "flt6_needs_description": _with(f"SELECT doc_id, seq, block_type IN {_PICTURES} AS needs_description FROM parsed", "parsed"),
        "fn7_bracket_state": _with(
        """SELECT doc_id, seq, CAST(CASE WHEN low < 0 THEN -1 WHEN now > 0 THEN 1 ELSE 0 END AS INTEGER) AS state FROM (SELECT doc_id, seq, min(s) AS low, arg_max(s, i) AS now FROM (
  SELECT doc_id, seq, i, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, seq ORDER BY i) AS s FROM (
    SELECT doc_id, seq, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN '(' WHEN 1 THEN ')' ELSE '' END || text AS t FROM parsed))) GROUP BY doc_id, seq)""", "parsed"),
    "prj12_capitalized": "SELECT p_partkey, upper(substr(trim(p_name), 1, 1)) || lower(substr(trim(p_name), 2)) AS kind FROM part",
    "prj16_file_names": r"SELECT page_id, f AS file_name, CASE WHEN length(f) > 1 THEN substr(f, 1, 1) || regexp_replace(substr(f, 2), '\.[^.]*$', '') ELSE f END AS stem FROM (SELECT page_id, string_split(url, '/')[-1] AS f FROM pages)",
    "prj5_plain_text": r"SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') AS text FROM pages",
    "prj19_image_text": _with(f"SELECT doc_id, seq, '![граф][' || text || '](D' || CASE WHEN seq % 2 = 0 THEN '. Ключевые слова: a, b' ELSE '' END || ')' AS text FROM parsed WHERE block_type IN {_PICTURES}", "parsed"),
    "flt9_answer_check": "SELECT doc_id, coalesce(length(text) BETWEEN 50 AND 1200 AND doc_id % 2 = 0, false) AS valid FROM documents",
    "fn2_answer_text": _with("SELECT doc_id, seq, text FROM parsed", "parsed"),
    "agg13_remaining_work": _with(f"SELECT doc_id, count(*) FILTER (w) AS remaining, bool_and(NOT w) AS all_done FROM (SELECT doc_id, {_needs('t')} AS w FROM (SELECT *, {_FAKE_MARK} AS t FROM parsed)) GROUP BY doc_id", "parsed"),
    "src9_base64": "SELECT page_id, to_base64(encode(html)) AS base64 FROM pages",
    "mdl10_sparse_terms": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda w: w <> '') AS words FROM documents), c AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY doc_id, n, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, term, tf, round(ln((c.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.n / c.mean)), 6) AS weight FROM tf JOIN df USING (term), c""",
}
