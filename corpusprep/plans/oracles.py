"""DuckDB SQL oracles, one per registered query, same column names.

The stand-in inputs are rebuilt with the ``*_SQL`` CTEs of
:mod:`corpusprep.plans.standins`. Lists of fixed values (extensions, missing-value
words) are the library's; the logic is written anew.
"""

from __future__ import annotations

import re

from corpusprep.functions.html import ENTITIES
from corpusprep.operators.routing import CONVERTER_FORMATS, REGISTRATIONS
from corpusprep.operators.text import CODE_EXTS, INVALID_JSON
from corpusprep.operators.slides import LEGACY_NOTICE
from corpusprep.plans.convert import NOT_BUILT
from corpusprep.operators.tables import NA_VALUES
from corpusprep.plans.standins import CSV_LINES_SQL, DOC_FILES_SQL, IMG_PAGES_SQL, MD_DOCS_SQL

# HTML to Markdown as a chain of replacements, for the tags that the test pages have. It shares nothing with
# the library's pass over tags and texts. Replacements refer to groups as ``$n``.
HTML_STEPS: list[tuple[str, str]] = [
    (r"(?is)<!doctype[^>]*>|<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>", ""),
    (r"\*", r"\\*"),
    (r"(?is)<pre[^>]*>[ \t\r\n]*<code[^>]*>(.*?)</code>[ \t\r\n]*</pre>", "\n\n```\n$1\n```\n\n"),
    (r"(?is)<code[^>]*>([^<]*)</code>", "`$1`"),
    (r"(?i)<(?:b|strong)(?:[ \t\r\n][^>]*)?>([^<]*)</(?:b|strong)>", "**$1**"),
    (r"(?i)<(?:i|em)(?:[ \t\r\n][^>]*)?>([^<]*)</(?:i|em)>", "*$1*"),
    (r"(?i)<img[ \t\r\n][^>]*?alt=\"([^\"]*)\"[^>]*?src=\"([^\"]*)\"[^>]*>", "![$1]($2)"),
    (r"(?i)<img[ \t\r\n][^>]*?src=\"([^\"]*)\"[^>]*?alt=\"([^\"]*)\"[^>]*>", "![$2]($1)"),
    (r"(?i)<img[ \t\r\n][^>]*?src=\"([^\"]*)\"[^>]*>", "![]($1)"),
    (r"(?is)<a[ \t\r\n][^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</a>", "[$2]($1)"),
    (r"(?is)<h1(?:[ \t\r\n][^>]*)?>(.*?)</h1>", "\n\n# $1\n\n"),
    (r"(?is)<h2(?:[ \t\r\n][^>]*)?>(.*?)</h2>", "\n\n## $1\n\n"),
    (r"(?is)<h3(?:[ \t\r\n][^>]*)?>(.*?)</h3>", "\n\n### $1\n\n"),
    (r"(?is)<h4(?:[ \t\r\n][^>]*)?>(.*?)</h4>", "\n\n#### $1\n\n"),
    (r"(?is)<h5(?:[ \t\r\n][^>]*)?>(.*?)</h5>", "\n\n##### $1\n\n"),
    (r"(?is)<h6(?:[ \t\r\n][^>]*)?>(.*?)</h6>", "\n\n###### $1\n\n"),
    (r"(?i)<li(?:[ \t\r\n][^>]*)?>", "\n- "),
    (r"(?i)<br[ \t\r\n]*/?>", "\n"),
    (r"(?i)</?(?:p|div|ul|ol|nav|article|section|header|footer|main|aside|table|tr|blockquote|h[1-6])(?:[ \t\r\n][^>]*)?>", "\n\n"),
    (r"<[^>]*>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&nbsp;", " "),
    (r"&copy;", "©"),
    (r"&middot;", "·"),
    (r"&amp;", "&"),
    (r"[ \t]*\n[ \t]*", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\n+|\n+\z", ""),
]

ORACLES: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx_replace(expr: str, pattern: str, repl: str) -> str:
    duck_repl = re.sub(r"\$(\d)", r"\\\1", repl)
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(duck_repl)}, 'g')"


def html_chain(expr: str) -> str:
    for pattern, repl in HTML_STEPS:
        expr = rx_replace(expr, pattern, repl)
    return expr


def entities(expr: str) -> str:
    for ent, ch in ENTITIES:
        expr = f"replace({expr}, {lit(ent)}, {lit(ch)})"
    return expr


def basename(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def raw_ext(p: str) -> str:
    return f"regexp_extract({basename(p)}, '^\\.*[^.].*(\\.[^.]*)$', 1)"


def ext(p: str) -> str:
    return f"lower({raw_ext(p)})"


def stem(p: str) -> str:
    return f"substr({basename(p)}, 1, length({basename(p)}) - length({raw_ext(p)}))"


def is_temp(p: str) -> str:
    n = basename(p)
    return (f"(starts_with({n}, '~') OR starts_with({n}, '.~') OR ends_with({n}, '.tmp') "
            f"OR ends_with({n}, '.bak') OR lower({n}) IN ('thumbs.db', 'desktop.ini', '.ds_store'))")


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def clean_cell(e: str) -> str:
    s = py_strip(e)
    esc = f"regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '([|\\[\\]])', '\\\\\\1', 'g')"
    return f"CASE WHEN {e} IS NULL OR {s} = '' OR lower({e}) IN ('nan', 'none', 'null') THEN '' ELSE {py_strip(esc)} END"


def clean_column_name(e: str) -> str:
    s = py_strip(e)
    return (f"CASE WHEN {e} IS NULL OR {s} IN ('', 'nan', 'NaN', 'None') THEN 'Unnamed_Column' "
            f"ELSE translate({s}, {lit('|' + chr(10) + chr(13))}, '_  ') END")


def table_part(ord_: str) -> str:
    """Part of a table that a row is in: ten thousand order keys each."""
    return f"CAST(floor(({ord_}) / 10000) AS BIGINT)"


def ext_img_name(u: str) -> str:
    e = f"regexp_extract({basename(u)}, '^\\.*[^.].*(\\.[^.]*)$', 1)"
    return f"('ext_img_' || substr(md5({u}), 1, 12) || CASE WHEN length({e}) = 0 OR length({e}) > 5 THEN '.jpg' ELSE {e} END)"


def registry_values() -> str:
    rows, i = [], 0
    for proc, exts in REGISTRATIONS:
        for e in exts:
            rows.append(f"({lit(e)}, {lit(proc)}, {i})")
            i += 1
    return "reg(ext, processor, ord) AS (VALUES " + ", ".join(rows) + ")"


CONV_VALUES = "conv(ext) AS (VALUES " + ", ".join(f"({lit(e)})" for e in CONVERTER_FORMATS) + ")"

ROUTED_SQL = f"""
{registry_values()},
r AS (SELECT ext, processor FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY ord DESC) rn FROM reg) WHERE rn = 1),
{CONV_VALUES},
f AS (SELECT *, {ext('path')} AS ext FROM doc_files),
routed AS (
  SELECT f.*, coalesce(r.processor, CASE WHEN c.ext IS NOT NULL THEN 'converter' END, 'simple') AS processor,
         (r.processor IS NOT NULL OR c.ext IS NOT NULL) AS supported,
         {is_temp('f.path')} AS is_temp
  FROM f LEFT JOIN r ON r.ext = f.ext LEFT JOIN conv c ON c.ext = f.ext)"""


def pretty_flat_json(p: str) -> str:
    return (f"('{{' || chr(10) || array_to_string(list_transform(json_keys({p}), lambda k: '  ' || to_json(k)::VARCHAR || ': ' "
            f"|| json_extract({p}, '$.\"' || k || '\"')::VARCHAR), ',' || chr(10)) || chr(10) || '}}')")


def render_simple_sql(src: str) -> str:
    code = ", ".join(lit(c) for c in CODE_EXTS)
    return f"""
  SELECT *, CASE WHEN e = '.json' THEN 'json_simple' WHEN e IN ({code}) THEN 'code_simple' ELSE 'txt_simple' END AS parser,
         CASE WHEN e IN ({code}) THEN substr(e, 2) END AS language,
         CASE WHEN e = '.json' AND json_valid(text) THEN '```json' || chr(10) || {pretty_flat_json('text')} || chr(10) || '```'
              WHEN e = '.json' THEN '```' || chr(10) || text || chr(10) || '```'
              WHEN e IN ({code}) THEN '```' || substr(e, 2) || chr(10) || text || chr(10) || '```'
              ELSE text END AS markdown,
         CASE WHEN e = '.json' AND NOT json_valid(text) THEN {lit(INVALID_JSON)} END AS error
  FROM (SELECT *, {ext('path')} AS e FROM {src})"""


# ---------------------------------------------------------------- HTML

_TITLE = f"nullif(trim({entities('regexp_extract(html, ' + lit('(?is)<title[^>]*>(.*?)</title>') + ', 1)')}), '')"

ORACLES["html_markdown"] = f"""
WITH conv AS (SELECT page_id, {_TITLE} AS title, {html_chain('html')} AS body FROM pages)
SELECT page_id, title,
  {rx_replace("replace(CASE WHEN title IS NULL THEN body ELSE '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || chr(10) || body END, 'media/media/', 'media/')", r"(\n\n): \[\]\{.*?\}(Tabela[^\n]+)", "\n\n**$2**")} AS markdown
FROM conv"""

ORACLES["html_link_list"] = f"""
WITH x AS (SELECT page_id, regexp_extract_all(html, {lit('(?i)<a[ ' + chr(9) + chr(13) + chr(10) + '][^>]*?href="([^"]*)"')}, 1) AS l FROM pages)
SELECT page_id, CAST(pos AS BIGINT) AS pos, href FROM (
  SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href FROM x)"""

_MD_PAGES = f"""
conv AS (SELECT page_id, {_TITLE} AS title, {html_chain('html')} AS body FROM pages),
md AS (SELECT page_id, {rx_replace("replace(CASE WHEN title IS NULL THEN body ELSE '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || chr(10) || body END, 'media/media/', 'media/')", r"(\n\n): \[\]\{.*?\}(Tabela[^\n]+)", "\n\n**$2**")} AS markdown FROM conv)"""

ORACLES["html_toc"] = f"""
WITH {_MD_PAGES}
SELECT page_id, array_to_string(list_transform(regexp_extract_all(markdown, '(?m)^(#{{1,6}}) (.+)$', 0),
    lambda h: repeat('  ', length(regexp_extract(h, '^(#+)', 1)) - 1) || '- ' || regexp_extract(h, '^#+ (.*)$', 1)), chr(10)) AS toc
FROM md"""

_IMG_RX = "(?i)<img[ \t\r\n][^>]*?src=[\"']([^\"']*)[\"']"
_EXT_REFS = f"""
{IMG_PAGES_SQL},
x AS (SELECT page_id, html, regexp_extract_all(html, {lit(_IMG_RX)}, 1) AS l FROM img_pages),
allsrc AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS url FROM x),
refs AS (SELECT * FROM allsrc WHERE starts_with(url, 'http://') OR starts_with(url, 'https://'))"""

ORACLES["html_external_images"] = f"""
WITH {_EXT_REFS}
SELECT page_id, CAST(pos AS BIGINT) AS pos, url, {ext_img_name('url')} AS local_name FROM refs"""

ORACLES["html_fetch_plan"] = f"""
WITH {_EXT_REFS},
existing AS (SELECT {ext_img_name("'https://cdn.example.org/' || CAST(i AS VARCHAR) || '/banner'")} AS name FROM range(0, 7) t(i) WHERE i % 2 = 0),
u AS (SELECT DISTINCT url FROM refs)
SELECT url, {ext_img_name('url')} AS local_name, 'media/' || {ext_img_name('url')} AS local_path FROM u
WHERE {ext_img_name('url')} NOT IN (SELECT name FROM existing)"""

_U1 = "(regexp_replace(url, '[?#].*$', '') || '/logo.png')"
_U2 = "('https://cdn.example.org/' || CAST(page_id % 7 AS VARCHAR) || '/banner')"
ORACLES["html_localized"] = f"""
WITH {IMG_PAGES_SQL}
SELECT page_id,
  replace(replace(html, 'src="' || {_U1} || '"', 'src="media/' || {ext_img_name(_U1)} || '"'),
          'src="' || {_U2} || '"', 'src="media/' || {ext_img_name(_U2)} || '"') AS html
FROM img_pages"""

ORACLES["html_image_report"] = f"""
WITH {_EXT_REFS}
SELECT page_id, CAST(count(*) AS BIGINT) AS total_images, CAST(count(DISTINCT url) AS BIGINT) AS unique_images,
       'File contains ' || CAST(count(*) AS VARCHAR) || ' external image(s). Processing may take longer than usual.' AS notice
FROM refs GROUP BY page_id"""

_FM_MD = ("('---' || chr(10) || 'title: ' || source || ' ' || chr(10) || '---' || chr(10) || text || chr(10) || chr(10) "
          "|| ': []{#tbl-' || CAST(doc_id AS VARCHAR) || '}Tabela ' || lang || chr(10) || '![x](media/media/img' "
          "|| CAST(doc_id AS VARCHAR) || '.png) \" **;**')")
_FM_RX = "(?ms)^---\\s*\\ntitle:\\s*(.*?)\\n"
ORACLES["converter_fixes"] = f"""
SELECT doc_id,
  CASE WHEN regexp_matches({_FM_MD}, {lit(_FM_RX)}) THEN {py_strip(f"regexp_extract({_FM_MD}, {lit(_FM_RX)}, 1)")} END AS title,
  replace(replace({rx_replace(_FM_MD, r"(\n\n): \[\]\{.*?\}(Tabela[^\n]+)", "\n\n**$2**")}, 'media/media/', 'media/'), ' " **;**', '"**;**') AS markdown
FROM documents"""

# ---------------------------------------------------------------- routing

ORACLES["file_routing"] = f"""
WITH {DOC_FILES_SQL}, {ROUTED_SQL}
SELECT doc_id, path, ext, processor, supported FROM routed"""

ORACLES["temp_file_flags"] = f"""
WITH {DOC_FILES_SQL}
SELECT doc_id, {basename('path')} AS name, {is_temp('path')} AS is_temp FROM doc_files"""

ORACLES["processable_files"] = f"""
WITH {DOC_FILES_SQL}, {ROUTED_SQL}
SELECT doc_id, path FROM routed WHERE ext IN (SELECT ext FROM reg) AND NOT is_temp"""

ORACLES["supported_files"] = f"""
WITH {DOC_FILES_SQL}, {ROUTED_SQL}
SELECT doc_id, path, processor FROM routed WHERE supported AND NOT is_temp"""

ORACLES["skipped_files"] = f"""
WITH {DOC_FILES_SQL}, {ROUTED_SQL}
SELECT doc_id, path, CASE WHEN supported THEN 'temporary or system file' ELSE 'unsupported extension: ' || ext END AS reason
FROM routed WHERE NOT (supported AND NOT is_temp)"""

ORACLES["package_names"] = f"""
WITH {DOC_FILES_SQL}
SELECT doc_id, {stem('path')} || '_rag' AS package, {stem('path')} || '_rag.md' AS md_name,
       {stem('path')} || '_rag.zip' AS zip_name FROM doc_files"""

ORACLES["package_collisions"] = f"""
WITH {DOC_FILES_SQL}, {ROUTED_SQL},
named AS (SELECT path, {stem('path')} AS package FROM routed WHERE supported AND NOT is_temp),
c AS (SELECT package, count(*) AS sources, max(path) AS survivor_path FROM named GROUP BY package HAVING count(*) > 1)
SELECT n.package, n.path, CAST(c.sources AS BIGINT) AS sources, n.path = c.survivor_path AS survivor
FROM named n JOIN c USING (package)"""

# ---------------------------------------------------------------- text columns

ORACLES["decoded_text"] = """
SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)) || chr(13) || 'end', '\\r\\n?', chr(10), 'g') AS text
FROM documents"""

ORACLES["detected_encoding"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]') THEN 'latin-1' ELSE 'utf-8' END AS encoding, text
FROM documents"""

ORACLES["cleaned_cells"] = f"""
SELECT doc_id, {clean_cell('text')} AS cell, {clean_column_name('text')} AS column_name,
       {clean_column_name('source')} AS source_name
FROM documents"""

ORACLES["text_documents"] = f"""
WITH {DOC_FILES_SQL}
SELECT doc_id, parser, language, markdown FROM ({render_simple_sql('doc_files')})"""

ORACLES["json_documents"] = f"""
WITH files AS (
  SELECT event_id, '/corpus/in/event_' || CAST(event_id AS VARCHAR) || '.json' AS path,
         CASE WHEN event_id % 7 = 0 THEN props || ',' ELSE props END AS text FROM events)
SELECT event_id, json_valid(text) AS valid, markdown, error FROM ({render_simple_sql('files')})"""

# ---------------------------------------------------------------- Markdown links

_MD_RX = r'!\[([^\]]*)\]\(([^)\s]+)(?:\s*"([^"]*)")?\)'
_HTML_RX = r"""(?i)<img\s+[^>]*?src\s*=\s*(?:'\s*([^'"]+)\s*'|"\s*([^'"]+)\s*")"""


def _kind(r: str) -> str:
    return (f"CASE WHEN starts_with({r}, 'http://') OR starts_with({r}, 'https://') THEN 'external' "
            f"WHEN starts_with({r}, 'data:') THEN 'data' WHEN starts_with({r}, '/') THEN 'absolute' ELSE 'local' END")


def _norm(p: str) -> str:
    return (f"('/' || array_to_string(list_reduce(string_split({p}, '/'), lambda acc, s: CASE WHEN s = '' OR s = '.' THEN acc "
            f"WHEN s = '..' THEN CASE WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1] ELSE acc END "
            f"ELSE list_append(acc, s) END, []::VARCHAR[]), '/'))")


def _flat(r: str) -> str:
    f = f"replace(replace(replace({r}, '../', ''), './', ''), '/', '_')"
    return f"CASE WHEN regexp_matches({f}, '^\\.*[^.].*\\.[^.]*$') THEN {f} ELSE {f} || '.png' END"


_REFS = f"""
{MD_DOCS_SQL},
x AS (SELECT doc_key, path, markdown, regexp_extract_all(markdown, {lit(_MD_RX)}, 2) AS l0,
             regexp_extract_all(markdown, {lit(_HTML_RX)}, 1) AS h1, regexp_extract_all(markdown, {lit(_HTML_RX)}, 2) AS h2
      FROM md_docs),
refs AS (
  SELECT doc_key, 0 AS syntax, generate_subscripts(l0, 1) - 1 AS pos, unnest(l0) AS ref FROM x
  UNION ALL
  SELECT doc_key, 1 AS syntax, i - 1 AS pos, CASE WHEN h1[i] <> '' THEN h1[i] ELSE h2[i] END AS ref
  FROM (SELECT doc_key, h1, h2, unnest(generate_series(1, len(h1))) AS i FROM x)),
dref AS (SELECT doc_key, ref, min(syntax * 1000000000 + pos) AS first FROM refs GROUP BY doc_key, ref),
res AS (
  SELECT d.doc_key, d.ref, d.first // 1000000000 AS syntax, d.first % 1000000000 AS pos,
         {_norm("regexp_extract(m.path, '^(.*)/[^/]*$', 1) || '/' || d.ref")} AS resolved
  FROM dref d JOIN md_docs m USING (doc_key) WHERE {_kind('d.ref')} = 'local'),
res2 AS (
  SELECT *, resolved IN (SELECT path FROM media) AS exists, {_flat('ref')} AS media_name FROM res)"""

ORACLES["md_image_refs"] = f"""
WITH {_REFS}
SELECT doc_key, CAST(syntax AS BIGINT) AS syntax, CAST(pos AS BIGINT) AS pos, ref FROM refs"""

ORACLES["md_distinct_refs"] = f"""
WITH {_REFS}
SELECT doc_key, ref, CAST(first // 1000000000 AS BIGINT) AS syntax, CAST(first % 1000000000 AS BIGINT) AS pos,
       {_kind('ref')} AS kind FROM dref"""

ORACLES["md_resolved_refs"] = f"""
WITH {_REFS}
SELECT doc_key, ref, resolved, exists, media_name, CASE WHEN exists THEN 'media/' || media_name END AS new_ref FROM res2"""

ORACLES["md_missing_refs"] = f"""
WITH {_REFS}
SELECT doc_key, ref, resolved FROM res2 WHERE NOT exists"""

ORACLES["md_name_clashes"] = f"""
WITH {_REFS}
SELECT doc_key, media_name, CAST(count(DISTINCT ref) AS BIGINT) AS refs FROM res2 WHERE exists
GROUP BY doc_key, media_name HAVING count(DISTINCT ref) > 1"""

_HTML_REW = r"(?i)(<img\s+[^>]*?src\s*=\s*)"
ORACLES["md_rewritten"] = f"""
WITH {_REFS},
lk AS (SELECT doc_key, list(struct_pack(ref := ref, new_ref := 'media/' || media_name) ORDER BY length(ref) DESC, syntax, pos) AS links
       FROM res2 WHERE exists GROUP BY doc_key)
SELECT m.doc_key, CASE WHEN lk.links IS NULL THEN m.markdown ELSE list_reduce(lk.links, lambda acc, l:
    regexp_replace(regexp_replace(regexp_replace(acc,
        '!\\[([^\\]]*)\\]\\(' || regexp_escape(l.ref) || '(\\s*"(?:[^"]*)")?\\)', '![\\1](' || l.new_ref || '\\2)', 'g'),
        {lit(_HTML_REW)} || '''' || regexp_escape(l.ref) || '''([^>]*?>)', '\\1''' || l.new_ref || '''\\2', 'g'),
        {lit(_HTML_REW)} || '"' || regexp_escape(l.ref) || '"([^>]*?>)', '\\1"' || l.new_ref || '"\\2', 'g'),
    m.markdown) END AS markdown
FROM md_docs m LEFT JOIN lk USING (doc_key)"""

# ---------------------------------------------------------------- tables

_NA = ", ".join(lit(v) for v in NA_VALUES)


def split_sql(line: str, sep: str) -> str:
    """Fields of a line. No quoted field of the stand-in files holds a separator or a quote."""
    return (f"list_transform(string_split({line}, {sep}), lambda f: CASE WHEN starts_with(f, '\"') AND ends_with(f, '\"') AND length(f) >= 2 "
            f"THEN substr(f, 2, length(f) - 2) ELSE f END)")


def na_empty(e: str) -> str:
    return f"CASE WHEN {e} IS NULL OR {e} IN ({_NA}) THEN '' ELSE {e} END"


def md_line(cells: str) -> str:
    return (f"('| ' || array_to_string(list_transform({cells}, lambda c: CASE WHEN {py_strip('coalesce(c, ' + lit('') + ')')} = '' "
            f"THEN '' ELSE c END), ' | ') || ' |')")


def sep_line(n: str) -> str:
    return f"('| ' || array_to_string(list_transform(range({n}), lambda i: '---'), ' | ') || ' |')"


def _table_ctes(lines_sql: str, kind: str = "CSV") -> str:
    """CTE chain from a ``csv_lines`` CTE (path, ord, line) to ``prof``; TSV skips scoring."""
    if kind == "CSV":
        dialect = f"""
heads AS (SELECT path, list(line ORDER BY ord) AS head FROM csv_lines GROUP BY path),
seps(separator, sep_ord) AS (VALUES (';', 0), (',', 1), (chr(9), 2)),
x AS (SELECT path, separator, sep_ord, head, list_filter(head, lambda l: l <> '') AS nb FROM heads, seps),
y AS (SELECT *, nb[1] AS header, len({split_sql('nb[1]', 'separator')}) AS ncols FROM x WHERE len(nb) > 0),
z AS (SELECT *, list_filter(nb[2:], lambda l: len({split_sql('l', 'separator')}) <= ncols) AS good FROM y),
w AS (SELECT *, len(good) AS n_df,
         coalesce(nullif({na_empty(split_sql('good[1]', 'separator') + '[1]')}, ''), 'nan') AS first_cell,
         list_transform(list_filter(list_transform(head, lambda l: {py_strip('l')}), lambda l: l <> ''),
                        lambda l: length(l) - length(replace(l, separator, ''))) AS counts,
         len(list_filter({split_sql('header', 'separator')}, lambda n: (separator <> ',' AND NOT contains(n, ','))
             OR (separator <> ';' AND NOT contains(n, ';')) OR (separator <> chr(9) AND NOT contains(n, chr(9))))) AS quality
      FROM z),
scores AS (
  SELECT path, separator, sep_ord, CASE WHEN n_df = 0 THEN 0 ELSE greatest(0,
      ncols * 10 + CASE WHEN separator = ';' THEN 15 ELSE 0 END
      + CASE WHEN ncols = 1 THEN -50 + CASE WHEN (separator = ';' AND contains(first_cell, ',')) OR (separator = ',' AND contains(first_cell, ';')) THEN -100 ELSE 0 END ELSE 0 END
      + CASE WHEN ncols > 1 THEN (CASE WHEN len(counts) = 0 THEN 0 WHEN len(list_distinct(counts)) = 1 THEN 20
                                       WHEN list_max(counts) - list_min(counts) <= 1 THEN 10 ELSE -10 END) + quality * 2 ELSE 0 END
      + CASE WHEN ncols > 100 THEN -30 ELSE 0 END) END AS score
  FROM w),
dialects AS (SELECT path, separator, score FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, sep_ord) AS r FROM scores) WHERE r = 1),"""
    else:
        dialect = "\ndialects AS (SELECT DISTINCT path, chr(9) AS separator, 0 AS score FROM csv_lines),"
    return f"""
{lines_sql},{dialect}
hdr AS (SELECT c.path, d.separator, d.score, min(c.ord) AS header_ord FROM csv_lines c JOIN dialects d USING (path)
        WHERE c.line <> '' GROUP BY c.path, d.separator, d.score),
hdr2 AS (SELECT h.*, {split_sql('c.line', 'h.separator')} AS names FROM hdr h JOIN csv_lines c ON c.path = h.path AND c.ord = h.header_ord),
hdr3 AS (SELECT *, len(names) AS ncols FROM hdr2),
body AS (SELECT c.path, c.ord, {split_sql('c.line', 'h.separator')} AS fields, h.ncols
         FROM csv_lines c JOIN hdr3 h ON c.path = h.path AND c.ord > h.header_ord WHERE c.line <> ''),
prof AS (
  SELECT h.path, h.separator, h.score, h.ncols, h.names,
         coalesce(sum(CASE WHEN len(b.fields) <= h.ncols THEN 1 ELSE 0 END), 0) AS total_rows,
         coalesce(sum(CASE WHEN len(b.fields) > h.ncols THEN 1 ELSE 0 END), 0) AS bad_lines
  FROM hdr3 h LEFT JOIN body b USING (path) GROUP BY h.path, h.separator, h.score, h.ncols, h.names)"""


_SCORES = _table_ctes(CSV_LINES_SQL)

ORACLES["csv_dialect_scores"] = f"WITH {_SCORES} SELECT path, separator, CAST(score AS BIGINT) AS score FROM scores"
ORACLES["csv_dialects"] = f"WITH {_SCORES} SELECT path, separator, CAST(score AS BIGINT) AS score FROM dialects"
ORACLES["csv_profiles"] = f"""WITH {_SCORES}
SELECT path, CAST(total_rows AS BIGINT) AS total_rows, CAST(ncols AS BIGINT) AS total_columns,
       CAST(total_rows AS BIGINT) AS displayed_rows, CAST(ncols AS BIGINT) AS displayed_columns,
       separator, CAST(score AS BIGINT) AS score, CASE WHEN bad_lines > 0 THEN 'skip_bad_lines' ELSE 'strict' END AS strategy,
       bad_lines > 0 AS had_parsing_issues,
       CASE WHEN total_rows > 0 THEN array_to_string(list_transform(names, lambda n, i: CASE WHEN trim(n) = '' THEN 'Unnamed: ' || CAST(i - 1 AS VARCHAR) ELSE n END), '|')
            ELSE '' END AS column_names
FROM prof"""
ORACLES["csv_quoted_records"] = """
SELECT '/corpus/csv/texts_' || coalesce(source, 'none') || '.csv' AS path, CAST(doc_id AS VARCHAR) AS doc_id,
  sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256, coalesce(lang, '') AS lang,
  CAST(3 AS BIGINT) AS n_fields, false AS bad
FROM documents"""

_CELL = clean_cell(na_empty("c"))
_HDR_NAMES = (f"list_transform(list_transform(names, lambda n, i: CASE WHEN trim(n) = '' THEN 'Unnamed: ' || CAST(i - 1 AS VARCHAR) ELSE n END), "
              f"lambda n: {clean_column_name('n')})")
def table_docs_sql(lines_sql: str, kind: str = "CSV", name: str | None = None) -> str:
    """``(path, part_no, parser, markdown, error)`` documents of delimited files in line form."""
    name = name or basename("p.path")
    dims = "'**Dimensions:** ' || CAST(p.total_rows AS VARCHAR) || ' rows × ' || CAST(p.ncols AS VARCHAR) || ' columns'"
    table = f"concat_ws(chr(10), {md_line(_HDR_NAMES)}, {sep_line('len(' + _HDR_NAMES + ')')}, t.body)"
    q = "'"
    if kind == "CSV":
        md = (
            f"CASE WHEN p.total_rows = 0 THEN '# Empty CSV File' || chr(10) || chr(10) || 'The file ' || {name} "
            f"|| ' appears to be empty or could not be read.' "
            f"ELSE concat_ws(chr(10), '# ' || {name} || chr(10), '**File Type:** CSV', '**Encoding:** utf-8', "
            f"'**Separator:** {q}{q}' || p.separator || '{q}{q}', "
            f"'**Parsing Strategy:** ' || CASE WHEN p.bad_lines > 0 THEN 'skip_bad_lines' ELSE 'strict' END, "
            f"'**Detection Score:** ' || printf('%.2f', CAST(p.score AS DOUBLE)), {dims}, "
            f"CASE WHEN p.bad_lines > 0 THEN '**Note:** Some malformed lines were skipped during parsing for data quality.' END, "
            f"chr(10) || '## Data' || chr(10), {table}) END"
        )
        err = "CASE WHEN p.total_rows = 0 THEN 'Empty or unreadable file' END"
    else:
        md = (
            f"concat_ws(chr(10), '# ' || {name} || chr(10), '**File Type:** {kind}', {dims}, "
            f"chr(10) || '## Data' || chr(10), CASE WHEN p.total_rows = 0 THEN '*No data found in file*' ELSE {table} END)"
        )
        err = "CAST(NULL AS VARCHAR)"
    parser = f"pandas_{kind.lower()}"
    cells = f"list_transform(list_transform(range(1, p.ncols + 1), lambda i: g.fields[i]), lambda c: {_CELL})"
    return f"""WITH {_table_ctes(lines_sql, kind)},
lines AS (SELECT g.path, g.ord, {md_line(cells)} AS line FROM body g JOIN prof p USING (path) WHERE len(g.fields) <= g.ncols),
tabs AS (SELECT path, {table_part('ord')} AS part_no, string_agg(line, chr(10) ORDER BY ord) AS body FROM lines GROUP BY ALL),
parts AS (SELECT path, CAST(0 AS BIGINT) AS part_no FROM prof UNION SELECT path, part_no FROM tabs),
docs AS (SELECT p.path, i.part_no, '{parser}' AS parser, CASE WHEN i.part_no = 0 THEN {md} ELSE t.body END AS markdown, {err} AS error
         FROM parts i JOIN prof p USING (path) LEFT JOIN tabs t ON t.path = i.path AND t.part_no = i.part_no)
SELECT * FROM docs
UNION ALL
SELECT DISTINCT path, CAST(0 AS BIGINT), '{parser}', NULL, 'Unable to parse CSV file with any common encoding/separator combination'
FROM csv_lines WHERE path NOT IN (SELECT path FROM hdr3)"""


ORACLES["csv_documents"] = table_docs_sql(CSV_LINES_SQL)

ORACLES["table_row_lines"] = """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey,
       '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS line
FROM nation"""

ORACLES["orders_first_rows"] = """
SELECT o_orderstatus, o_orderkey FROM (
  SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders)
WHERE r <= 1000"""


def _frame_table(src: str, cols: list[tuple[str, bool]], order: str, group: str | None = None) -> str:
    """SQL for cleaned Markdown tables of ``src`` in parts (``cols``: name, is_text)."""
    cells = ", ".join(clean_cell(f"coalesce({c}, '')") if t else f"CAST({c} AS VARCHAR)" for c, t in cols)
    names = ", ".join(lit(c) for c, _ in cols)
    g = f"{group}, " if group else ""
    over = f"PARTITION BY {group}" if group else ""
    return f"""
  SELECT {g}part_no, CASE WHEN part_no = 0 THEN {md_line('[' + names + ']')} || chr(10) || {sep_line(str(len(cols)))} || chr(10) ELSE '' END
         || string_agg({md_line('[' + cells + ']')}, chr(10) ORDER BY {order}) AS "table"
  FROM (SELECT *, {table_part(order)} - min({table_part(order)}) OVER ({over}) AS part_no FROM {src})
  GROUP BY {g}part_no"""


ORACLES["orders_status_tables"] = _frame_table(
    "orders", [("o_orderkey", False), ("o_custkey", False), ("o_orderpriority", True)], "o_orderkey", "o_orderstatus")

ORACLES["lineitem_first_columns"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       '| ' || concat_ws(' | ', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                         CAST(l_linenumber AS VARCHAR), CAST(l_quantity AS VARCHAR)) || ' |' AS line
FROM lineitem"""

ORACLES["customer_sanitized"] = f"""
SELECT c_custkey, {clean_cell("coalesce(c_name, '')")} AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       {clean_cell("coalesce(c_mktsegment, '')")} AS c_mktsegment
FROM customer"""

ORACLES["bundle_flags"] = f"""
WITH {CSV_LINES_SQL},
all_lines AS (SELECT path, ord, line FROM csv_lines
              UNION ALL SELECT '/corpus/csv/messages.csv', 0, 'bundle,"key",en,fr,de,es' FROM (SELECT count(*) FROM documents)),
firsts AS (SELECT path, arg_min(line, ord) AS first_line FROM all_lines GROUP BY path)
SELECT path, starts_with({py_strip('first_line')}, 'bundle,"key"') AS is_bundle FROM firsts"""

_LANGS = ["en", "fr", "de", "es"]
_BUNDLE_BASE = """
b AS (SELECT doc_id, source, lang, regexp_replace(text, chr(10), ' ', 'g') AS t FROM documents),
facts AS (SELECT count(*) AS total_entries, count(*) AS displayed, count(DISTINCT source) AS unique_bundles FROM b)"""

ORACLES["bundle_language_stats"] = f"""
WITH {_BUNDLE_BASE},
langs(lang) AS (VALUES {", ".join("(" + lit(x) + ")" for x in _LANGS)})
SELECT '/corpus/csv/messages.csv' AS path, l.lang, CAST(f.total_entries AS BIGINT) AS total_entries,
       CAST(f.displayed AS BIGINT) AS displayed_entries, CAST(f.unique_bundles AS BIGINT) AS unique_bundles,
       CAST(f.displayed AS BIGINT) AS translations,
       CAST((SELECT count(*) FROM b WHERE b.lang = l.lang AND b.t NOT IN ({_NA})) AS BIGINT) AS non_empty
FROM langs l, facts f"""


def _bundle_cell(e: str) -> str:
    esc = f"replace(replace(replace({e}, '|', '\\|'), chr(10), ' '), chr(13), ' ')"
    return f"CASE WHEN lower({py_strip(e)}) IN ('nan', 'none', 'null') THEN '' ELSE {esc} END"


_BUNDLE_ROW = ("'| ' || concat_ws(' | ', " + _bundle_cell("source") + ", " + _bundle_cell("'K' || CAST(doc_id AS VARCHAR)") + ", "
               + ", ".join(_bundle_cell(f"CASE WHEN lang = {lit(x)} THEN {clean_cell('t')} ELSE '' END") for x in _LANGS) + ") || ' |'")
ORACLES["bundle_documents"] = f"""
WITH {_BUNDLE_BASE},
parts AS (SELECT {table_part('doc_id + 1')} AS part_no, string_agg({_BUNDLE_ROW}, chr(10) ORDER BY doc_id) AS body FROM b GROUP BY 1)
SELECT '/corpus/csv/messages.csv' AS path, p.part_no, 'pandas_bundle_csv' AS parser, concat_ws(chr(10),
  CASE WHEN p.part_no = 0 THEN concat_ws(chr(10),
    '# messages.csv - Translation Bundle' || chr(10), '**File Type:** Translation Bundle (CSV)', '**Encoding:** utf-8',
    '**Structure:** Bundle translations with quoted text support', '**Languages:** en, fr, de, es',
    '**Total Entries:** ' || CAST(f.total_entries AS VARCHAR) || ' translation entries', '**Total Languages:** 4',
    chr(10) || '## Translation Data' || chr(10),
    '| bundle | key | en | fr | de | es |' || chr(10) || '| --- | --- | --- | --- | --- | --- |') END,
  p.body,
  CASE WHEN p.part_no = (SELECT max(part_no) FROM parts) THEN concat_ws(chr(10),
    chr(10) || '## Summary' || chr(10), '- **Unique Bundles:** ' || CAST(f.unique_bundles AS VARCHAR),
    {" || chr(10) || ".join(lit("- **" + x.upper() + " Translations:** ") + " || CAST(f.displayed AS VARCHAR)" for x in _LANGS)}) END) AS markdown
FROM parts p, facts f"""

_SHEETS = [("region", [("r_regionkey", False), ("r_name", True)], "r_regionkey"),
           ("nation", [("n_nationkey", False), ("n_name", True), ("n_regionkey", False)], "n_nationkey"),
           ("supplier", [("s_suppkey", False), ("s_name", True), ("s_nationkey", False), ("s_acctbal", False)], "s_suppkey")]


def _sheet_sql(i: int, name: str, cols, order: str) -> str:
    return f"""
  SELECT {i} AS idx, {lit(name)} AS sheet_name, part_no, (SELECT count(*) FROM {name}) AS row_count, {len(cols)} AS column_count, [{", ".join(lit(c) for c, _ in cols)}] AS col_names, "table" AS tbl
  FROM ({_frame_table(name, cols, order)})"""


ORACLES["workbook_documents"] = f"""
WITH sheets AS ({" UNION ALL ".join(_sheet_sql(i, n, c, o) for i, (n, c, o) in enumerate(_SHEETS))}),
facts AS (SELECT count(*) AS sheet_count, string_agg(sheet_name, ', ' ORDER BY idx) AS names, sum(row_count) AS total_rows,
                 max(column_count) AS max_columns,
                 '{{' || string_agg('"' || sheet_name || '":{{"rows":' || row_count || ',"columns":' || column_count || ',"column_names":["' || array_to_string(col_names, '","') || '"]}}', ',' ORDER BY idx) || '}}' AS data
          FROM sheets WHERE part_no = 0),
sec AS (SELECT row_number() OVER (ORDER BY idx, part_no) AS n,
          CASE WHEN part_no > 0 THEN tbl || chr(10) ELSE concat_ws(chr(10), '## Sheet: ' || sheet_name || chr(10),
               '**Dimensions:** ' || CAST(row_count AS VARCHAR) || ' rows × ' || CAST(column_count AS VARCHAR) || ' columns',
               chr(10), tbl || chr(10)) END AS section FROM sheets)
SELECT '/corpus/xlsx/tables.xlsx' AS workbook, CAST(n - 1 AS BIGINT) AS part_no, 'pandas_excel' AS parser,
  concat_ws(chr(10), CASE WHEN n = 1 THEN concat_ws(chr(10), '# tables.xlsx' || chr(10), '**File Type:** Excel',
            '**Number of Sheets:** ' || CAST(sheet_count AS VARCHAR), '**Sheet Names:** ' || names || chr(10)) END, section) AS markdown,
  CAST(sheet_count AS BIGINT) AS sheet_count, CAST(total_rows AS BIGINT) AS total_rows, CAST(max_columns AS BIGINT) AS max_columns,
  data AS sheets_data
FROM sec, facts"""

# ---------------------------------------------------------------- slides

_SLIDE_ROWS = f"""
s AS (
  SELECT conv_id, turn, role, text,
    '/corpus/slides/conv_' || CAST(conv_id AS VARCHAR) || CASE WHEN conv_id % 5 = 0 THEN '.ppt' ELSE '.pptx' END AS deck,
    split_part(text, chr(10), 1) AS first_line,
    (role = 'user' AND turn = 0) AS flagged,
    CASE role WHEN 'user' THEN unhex('89504E470D0A1A0A') WHEN 'assistant' THEN unhex('FFD8FFE0') ELSE unhex('474946383961') END || encode(text) AS img,
    CASE role WHEN 'user' THEN '.png' WHEN 'assistant' THEN '.jpg' ELSE '.gif' END AS img_ext,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS image_no
  FROM conversations),
s2 AS (
  SELECT *, CASE WHEN flagged OR role = 'system' THEN {py_strip('first_line')} END AS title,
    'ppt_img_' || CAST(image_no AS VARCHAR) || '_' || substr(md5(img), 1, 12) || img_ext AS img_name,
    CASE WHEN turn % 2 = 0 THEN 'Figure ' || CAST(turn AS VARCHAR) ELSE 'Picture ' || CAST(turn AS VARCHAR) END AS alt
  FROM s),
s3 AS (
  SELECT *, concat_ws(chr(10),
      '## ' || CASE WHEN title IS NOT NULL AND title <> '' THEN title ELSE 'Slide ' || CAST(turn + 1 AS VARCHAR) END || chr(10),
      nullif(concat_ws(chr(10),
          CASE WHEN NOT flagged AND {py_strip('first_line')} <> '' THEN {py_strip('first_line')} END,
          CASE WHEN {py_strip('text')} <> '' THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
              repeat('  ', (i - 1) % 3) || CASE WHEN (i - 1) % 3 = 0 THEN '* ' ELSE '- ' END || {py_strip('x')}), chr(10)) END), ''),
      chr(10) || '![' || alt || '](media/' || img_name || ')' || chr(10),
      CASE WHEN role = 'assistant' AND {py_strip('text')} <> '' THEN chr(10) || '> **Slide Notes:** ' || {py_strip('text')} || chr(10) END,
      chr(10) || '---' || chr(10)) AS section
  FROM s2)"""

ORACLES["slide_image_names"] = f"""WITH {_SLIDE_ROWS}
SELECT deck, CAST(turn + 1 AS BIGINT) AS slide_idx, CAST(image_no AS BIGINT) AS image_no, img_name AS name, alt FROM s3"""

ORACLES["slide_sections"] = f"""WITH {_SLIDE_ROWS}
SELECT deck, CAST(turn + 1 AS BIGINT) AS slide_idx, title, section FROM s3"""

_NOTICE = lit(LEGACY_NOTICE)
ORACLES["slide_decks"] = f"""WITH {_SLIDE_ROWS},
d AS (SELECT deck, conv_id, string_agg(section, chr(10) ORDER BY turn) AS body, count(*) AS slide_count,
             arg_min(coalesce(title, ''), turn) AS first_title FROM s3 GROUP BY deck, conv_id),
d2 AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'Deck ' || CAST(conv_id AS VARCHAR) ELSE nullif(first_title, '') END AS t FROM d)
SELECT deck, 'pptx_parser' AS parser,
  CASE WHEN ends_with(deck, '.ppt') THEN {_NOTICE} ELSE '' END || concat_ws(chr(10), CASE WHEN t <> '' THEN '# ' || t || chr(10) END, body) AS markdown,
  CAST(slide_count AS BIGINT) AS slide_count, CAST(slide_count AS BIGINT) AS image_count,
  CASE WHEN conv_id % 2 = 0 THEN t ELSE (SELECT s3.title FROM s3 WHERE s3.conv_id = d2.conv_id ORDER BY turn LIMIT 1) END AS title
FROM d2"""

ORACLES["slide_deck_parts"] = f"""WITH {_SLIDE_ROWS},
p AS (SELECT deck, conv_id, (turn + 1) // 4096 AS blk, string_agg(section, chr(10) ORDER BY turn) AS body FROM s3 GROUP BY ALL),
d AS (SELECT conv_id, count(*) AS slide_count, arg_min(struct_pack(t := title), turn).t AS first_title FROM s3 GROUP BY conv_id),
n AS (SELECT p.*, slide_count, row_number() OVER (PARTITION BY p.conv_id ORDER BY blk) - 1 AS part_no,
        CASE WHEN p.conv_id % 2 = 0 THEN 'Deck ' || CAST(p.conv_id AS VARCHAR) ELSE first_title END AS title FROM p JOIN d USING (conv_id))
SELECT deck, part_no, 'pptx_parser' AS parser,
  CASE WHEN part_no = 0 AND ends_with(deck, '.ppt') THEN {_NOTICE} ELSE '' END
    || concat_ws(chr(10), CASE WHEN part_no = 0 AND title <> '' THEN '# ' || title || chr(10) END, body) AS markdown,
  CAST(slide_count AS BIGINT) AS slide_count, CAST(slide_count AS BIGINT) AS image_count, title
FROM n"""

# ---------------------------------------------------------------- images

_IMG = """
im AS (
  SELECT p_partkey, p_name, p_size, p_partkey % 5 AS typ, p_size * 3 + p_partkey % 7 AS w, p_size * 2 + 1 AS h,
         'pdf_' || CAST(p_partkey % 50 AS VARCHAR) AS doc_key,
         'img_' || CAST(p_partkey AS VARCHAR) AS base,
         ['.png', '.jpg', '.gif', '.dat', '.jpeg'][p_partkey % 5 + 1] AS ext
  FROM part),
im2 AS (
  SELECT *, '/extract/' || doc_key || '/' || base || ext AS placeholder,
    CASE typ WHEN 0 THEN unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(w), 8, '0') || lpad(hex(h), 8, '0') || '0806000000')
             WHEN 2 THEN unhex('474946383961' || substr(lpad(hex(w), 4, '0'), 3, 2) || substr(lpad(hex(w), 4, '0'), 1, 2)
                               || substr(lpad(hex(h), 4, '0'), 3, 2) || substr(lpad(hex(h), 4, '0'), 1, 2) || 'F70000')
             WHEN 3 THEN ''::BLOB
             ELSE unhex('FFD8FFE000104A46494600010100000100010000FFC0001108' || lpad(hex(h), 4, '0') || lpad(hex(w), 4, '0') || '03012200021101031101') END
    || encode(repeat(p_name, p_size * 40)) AS bytes
  FROM im),
dec AS (
  SELECT *, typ <> 3 AS decodable,
    CASE WHEN typ <> 3 AND ext IN ('.jpg', '.jpeg') THEN 'JPEG' ELSE 'PNG' END AS fmt
  FROM im2),
dec2 AS (
  SELECT *, CASE WHEN decodable AND w < 50 AND h < 50 THEN 'remove' WHEN decodable AND octet_length(bytes) < 5120 THEN 'embed' ELSE 'relink' END AS action
  FROM dec),
dec3 AS (
  SELECT *, CASE WHEN action = 'embed' THEN 'data:image/' || lower(fmt) || ';base64,' || to_base64(bytes) END AS data_uri,
            CASE WHEN action = 'relink' THEN 'media/' || base || '.' || lower(fmt) END AS new_path
  FROM dec2)"""

ORACLES["image_types"] = f"""WITH {_IMG}
SELECT p_partkey, CASE typ WHEN 0 THEN '.png' WHEN 2 THEN '.gif' WHEN 3 THEN '.png' ELSE '.jpg' END AS ext FROM im"""

ORACLES["image_sizes"] = f"""WITH {_IMG}
SELECT p_partkey, CASE WHEN typ <> 3 THEN CAST(w AS BIGINT) END AS width, CASE WHEN typ <> 3 THEN CAST(h AS BIGINT) END AS height,
       typ <> 3 AS decodable FROM im"""

ORACLES["image_resize_plan"] = f"""WITH {_IMG}
SELECT p_partkey,
  CASE WHEN typ <> 3 THEN CAST(CASE WHEN greatest(w, h) > 100 THEN greatest(1, round(w * least(1.0, 100.0 / greatest(w, h)))) ELSE w END AS BIGINT) END AS target_width,
  CASE WHEN typ <> 3 THEN CAST(CASE WHEN greatest(w, h) > 100 THEN greatest(1, round(h * least(1.0, 100.0 / greatest(w, h)))) ELSE h END AS BIGINT) END AS target_height
FROM im"""

ORACLES["image_decisions"] = f"""WITH {_IMG}
SELECT p_partkey, action, fmt AS format, data_uri, new_path FROM dec3"""

ORACLES["image_decorative"] = f"""WITH {_IMG}
SELECT p_partkey, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height FROM im WHERE typ <> 3 AND w < 50 AND h < 50"""

ORACLES["image_embedded"] = f"""WITH {_IMG}
SELECT p_partkey, 'data:image/' || lower(fmt) || ';base64,' || to_base64(bytes) AS data_uri FROM dec WHERE octet_length(bytes) < 5120"""

ORACLES["pdf_documents"] = f"""WITH {_IMG}
SELECT doc_key, replace(string_agg('Text ' || p_name || chr(10) ||
    CASE WHEN action = 'remove' THEN '' ELSE '![Image ' || CAST(p_partkey AS VARCHAR) || '](' || coalesce(data_uri, new_path)
         || CASE WHEN p_partkey % 4 = 0 THEN ' "caption"' ELSE '' END || ')' END, chr(10) ORDER BY p_partkey), ' " **;**', '"**;**') AS markdown
FROM dec3 GROUP BY doc_key"""

ORACLES["image_summary"] = f"""WITH {_IMG}
SELECT doc_key, action, CAST(count(*) AS BIGINT) AS images, CAST(sum(octet_length(bytes)) AS BIGINT) AS bytes
FROM dec3 GROUP BY ROLLUP (doc_key, action)"""

# ---------------------------------------------------------------- packages and report


def _json_field(name: str, e: str, first: bool = False) -> str:
    sep = "" if first else ","
    return f"CASE WHEN {e} IS NOT NULL THEN '{sep}\"{name}\":' || to_json({e})::VARCHAR ELSE '' END"


ORACLES["metadata_documents"] = f"""
WITH {DOC_FILES_SQL}, {ROUTED_SQL},
simple AS ({render_simple_sql("(SELECT * FROM routed WHERE supported AND NOT is_temp AND processor = 'simple')")})
SELECT doc_id, '{{' || {_json_field('source_filename', basename('path'), True)} || {_json_field('parser', 'parser')}
       || {_json_field('language', 'language')} || {_json_field('error', 'error')} || '}}' AS metadata
FROM simple"""

ORACLES["metadata_merged"] = """
SELECT doc_id, 'txt_simple' AS parser, CAST(5 AS BIGINT) AS n_keys, lang, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS source_filename
FROM documents"""

_MEDIA = """
media_src AS (
  SELECT 'doc_' || CAST(p_partkey * 7 % 1000 AS VARCHAR) AS package,
         CASE WHEN p_partkey % 2 = 0 THEN 'media/' ELSE 'media/media/' END || 'p' || CAST(p_partkey AS VARCHAR) || '.png' AS entry,
         encode(p_name) AS bytes FROM part
  UNION ALL
  SELECT 'doc_' || CAST(p_partkey * 7 % 1000 AS VARCHAR), 'media/media/p' || CAST(p_partkey AS VARCHAR) || '.png', encode(upper(p_name))
  FROM part WHERE p_partkey % 6 = 0),
flat AS (
  SELECT package, final AS entry, entry AS source_entry, bytes FROM (
    SELECT *, row_number() OVER (PARTITION BY package, final ORDER BY depth) AS rn FROM (
      SELECT *, CASE WHEN starts_with(entry, 'media/media/') THEN 'media/' || substr(entry, 13) ELSE entry END AS final,
                CASE WHEN starts_with(entry, 'media/media/') THEN 1 ELSE 0 END AS depth FROM media_src))
  WHERE rn = 1)"""

ORACLES["media_flattened"] = f"WITH {_MEDIA} SELECT package, entry, source_entry, md5(bytes) AS digest FROM flat"

ORACLES["package_entry_list"] = f"""
WITH {_MEDIA},
docs AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS package, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS markdown FROM documents),
ok AS (SELECT * FROM docs WHERE length(markdown) > 0)
SELECT package, package || '.md' AS entry, 'markdown' AS kind, CAST(octet_length(encode(markdown)) AS BIGINT) AS size, md5(markdown) AS digest FROM ok
UNION ALL
SELECT package, 'metadata.json', 'metadata',
       CAST(octet_length(encode('{{"source_filename":"' || package || '.txt","parser":"txt_simple"}}')) AS BIGINT),
       md5('{{"source_filename":"' || package || '.txt","parser":"txt_simple"}}') FROM ok
UNION ALL
SELECT f.package, f.entry, 'media', CAST(octet_length(f.bytes) AS BIGINT), md5(f.bytes) FROM flat f WHERE f.package IN (SELECT package FROM ok)"""

_NONBLANK = "len(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '\\r$', '') <> '')) > 0"
_OUTCOMES = f"""
{DOC_FILES_SQL}, {ROUTED_SQL},
o AS (
  SELECT doc_id, path, ext, processor, supported AND NOT is_temp AS todo,
    CASE WHEN ext = '.json' THEN 'json_simple' WHEN ext IN ({", ".join(lit(c) for c in CODE_EXTS)}) THEN 'code_simple' ELSE 'txt_simple' END AS simple_parser,
    CASE
      WHEN processor = 'simple' THEN ext = '.json' OR ext IN ({", ".join(lit(c) for c in CODE_EXTS)}) OR length(text) > 0
      WHEN processor = 'markdown' THEN length(text) > 0
      WHEN processor = 'converter' AND ext IN ('.html', '.htm') THEN length({html_chain('text')}) > 0
      WHEN processor = 'tabular' AND ext IN ('.csv', '.tsv') THEN {_NONBLANK}
      ELSE false END AS produced
  FROM routed),
outs AS (
  SELECT doc_id, path,
    CASE WHEN NOT todo THEN processor
         WHEN processor = 'simple' THEN simple_parser WHEN processor = 'markdown' THEN 'md_custom'
         WHEN processor = 'converter' AND ext IN ('.html', '.htm') THEN 'pandoc'
         WHEN processor = 'tabular' AND ext = '.csv' THEN 'pandas_csv' WHEN processor = 'tabular' AND ext = '.tsv' THEN 'pandas_tsv'
         ELSE processor END AS parser,
    CASE WHEN NOT todo THEN 'skipped' WHEN produced THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN NOT todo THEN 'Skipping unsupported file' WHEN produced THEN 'Successfully processed'
         WHEN processor = 'tabular' AND ext IN ('.csv', '.tsv') THEN 'Unable to parse CSV file with any common encoding/separator combination'
         WHEN processor IN ('simple', 'markdown') OR (processor = 'converter' AND ext IN ('.html', '.htm')) THEN 'Failed to process'
         ELSE {lit(NOT_BUILT)} END AS message
  FROM o)"""

ORACLES["file_outcomes"] = f"WITH {_OUTCOMES} SELECT doc_id, path, parser, status, message FROM outs"
ORACLES["batch_report"] = f"""WITH {_OUTCOMES}
SELECT parser, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS ok,
       CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed
FROM outs WHERE status <> 'skipped' GROUP BY parser"""
ORACLES["batch_progress"] = f"""WITH {_OUTCOMES}
SELECT doc_id, CAST(row_number() OVER (ORDER BY path, doc_id) AS DOUBLE) / count(*) OVER () * 100 AS percent
FROM outs WHERE status <> 'skipped'"""

# ---------------------------------------------------------------- table-form conversion


def _lines_of(kind_ext: str) -> str:
    return f"""csv_lines AS (
  SELECT path, CAST(ord AS BIGINT) AS ord, regexp_replace(line, '\\r$', '') AS line FROM (
    SELECT path, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS line FROM (
      SELECT path, string_split(text, chr(10)) AS l FROM routed
      WHERE supported AND NOT is_temp AND processor = 'tabular' AND ext = '{kind_ext}')))"""


ORACLES["corpus_documents"] = f"""
WITH {DOC_FILES_SQL.replace("doc_files AS (", "docs0 AS (", 1)},
doc_files AS (SELECT doc_id, path, text FROM docs0
              UNION ALL SELECT -1 - page_id, '/corpus/in/page_' || CAST(page_id AS VARCHAR) || '.html', html FROM pages),
{ROUTED_SQL},
todo AS (SELECT * FROM routed WHERE supported AND NOT is_temp),
html_src AS (SELECT doc_id, path, {_TITLE.replace('html', 'text')} AS title, {html_chain('text')} AS body
             FROM todo WHERE processor = 'converter' AND ext IN ('.html', '.htm')),
tables AS (SELECT * FROM ({table_docs_sql(_lines_of('.csv'), 'CSV')}) UNION ALL SELECT * FROM ({table_docs_sql(_lines_of('.tsv'), 'TSV')})),
one AS (
  SELECT doc_id, path, parser, markdown, error FROM ({render_simple_sql("(SELECT * FROM todo WHERE processor = 'simple')")})
  UNION ALL
  SELECT doc_id, path, 'md_custom', text, NULL FROM todo WHERE processor = 'markdown'
  UNION ALL
  SELECT doc_id, path, 'pandoc',
    {rx_replace("replace(CASE WHEN title IS NULL THEN body ELSE '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || chr(10) || body END, 'media/media/', 'media/')", r"(\n\n): \[\]\{.*?\}(Tabela[^\n]+)", "\n\n**$2**")},
    NULL
  FROM html_src
  UNION ALL
  SELECT doc_id, path, processor, NULL, {lit(NOT_BUILT)} FROM todo
  WHERE processor NOT IN ('simple', 'markdown') AND NOT (processor = 'converter' AND ext IN ('.html', '.htm'))
    AND NOT (processor = 'tabular' AND ext IN ('.csv', '.tsv')))
SELECT doc_id, path, CAST(0 AS BIGINT) AS part_no, parser, markdown, error FROM one
UNION ALL
SELECT d.doc_id, t.path, t.part_no, t.parser, t.markdown, t.error FROM tables t JOIN todo d USING (path)"""
