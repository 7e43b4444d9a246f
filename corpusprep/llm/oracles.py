"""DuckDB SQL for the queries that SQL can express on whole tables, written apart from the operators."""

from __future__ import annotations

import math

from corpusprep.llm import chat_format, merkle_manifest, prefix_trie
from corpusprep.llm.quality_rules import FENCE, GAMMA, MIN_DOCS

#: Islands of spans that start at i (from 0) and are ``size`` long: one row (rid, lo, hi) for each maximal run.
_ISLANDS = """
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {size} THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS island FROM marked),
runs AS (SELECT rid, min(i) AS lo, max(i) + {size} AS hi FROM numbered GROUP BY rid, island)"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i + 1:i + 35], ' ') AS s FROM (SELECT rid, w, unnest(range(0, len(w) - 34)) AS i FROM d)),
hits AS (SELECT rid, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
{_ISLANDS.format(size=35)},
cut AS (SELECT rid, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS gone FROM runs GROUP BY rid),
kept AS (
  SELECT d.*, coalesce(gone, 0) AS gone,
    CASE WHEN los IS NULL THEN w ELSE flatten(list_transform(range(1, len(los) + 2), lambda k:
      w[(CASE WHEN k = 1 THEN 0 ELSE his[k - 1] END) + 1:CASE WHEN k > len(los) THEN len(w) ELSE los[k] END])) END AS rest
  FROM d LEFT JOIN cut USING (rid))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept"""

BYTE_SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT rid, doc_id, i, b[i + 1:i + 100] AS s FROM (SELECT rid, doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM d)),
firsts AS (SELECT s, min(struct_pack(doc_id := doc_id, i := i)) AS earliest FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT rid, i FROM windows JOIN firsts USING (s) WHERE struct_pack(doc_id := doc_id, i := i) > earliest),
{_ISLANDS.format(size=100)},
cut AS (SELECT rid, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS gone, count(*) AS n FROM runs GROUP BY rid),
kept AS (
  SELECT d.*, coalesce(gone, 0) AS gone, coalesce(n, 0) AS n,
    CASE WHEN los IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(1, len(los) + 2), lambda k:
      hex(b)[2 * (CASE WHEN k = 1 THEN 0 ELSE his[k - 1] END) + 1:2 * CASE WHEN k > len(los) THEN octet_length(b) ELSE los[k] END]), '') END AS rest
  FROM d LEFT JOIN cut USING (rid))
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans,
  sha256(unhex(rest)) AS kept_sha256
FROM kept"""

_MEASURES = [("symbols", "n_symbols / greatest(n_words, 1)", "1.0 / sqrt(greatest(n_words, 1))", False),
             ("repeated_words", "n_repeat_words / greatest(n_words, 1)", "2.0 / sqrt(greatest(n_words, 1))", False),
             ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", "0.6 / sqrt(greatest(n_lines, 1))", False),
             ("word_length", "word_chars / greatest(n_words, 1)", "2.0 / sqrt(greatest(n_words, 1))", True)]


def _at(bucket: str) -> str:
    return f"CASE WHEN {bucket} = 0 THEN 0 ELSE 1e-4 * pow({GAMMA}, {bucket} - 1) * 2 / {1 + GAMMA!r} END"


QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '~') AS lang, coalesce(source, '~') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM documents),
grams AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, g FROM grams GROUP BY rid, g HAVING count(*) > 1),
hit AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM grams JOIN twice USING (rid, g)) GROUP BY rid),
c AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
  FROM d LEFT JOIN hit USING (rid)),
v AS ({" UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{k}' AS measure, {e} AS v, {s} AS allowance, {str(t).lower()} AS two FROM c" for k, e, s, t in _MEASURES)}),
b AS (SELECT *, CASE WHEN v < 1e-4 THEN 0 ELSE CAST(ceil(ln(v / 1e-4) / {math.log(GAMMA)!r}) AS INT) + 1 END AS bucket FROM v WHERE NOT base_failed),
g AS (
  SELECT 0 AS level, lang, source, measure, bucket, two FROM b UNION ALL
  SELECT 1, lang, '', measure, bucket, two FROM b UNION ALL SELECT 2, '', '', measure, bucket, two FROM b),
r AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS k,
    count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM g),
q AS (
  SELECT level, lang, source, measure, two, n, min(bucket) FILTER (WHERE 10 * k >= n) AS b1, min(bucket) FILTER (WHERE 10 * k >= 5 * n) AS b5,
    min(bucket) FILTER (WHERE 10 * k >= 9 * n) AS b9
  FROM r GROUP BY ALL),
f AS (SELECT *, {_at('b1')} AS q1, {_at('b5')} AS q5, {_at('b9')} AS q9 FROM q),
used AS (
  SELECT v.rid, v.v, v.allowance, arg_min(struct_pack(lo := CASE WHEN f.two THEN q5 - {FENCE} * (q5 - q1) ELSE -1e9 END, hi := q5 + {FENCE} * (q9 - q5)), level) AS x
  FROM v JOIN f ON f.measure = v.measure AND f.lang IN (v.lang, '') AND f.source IN (v.source, '')
    AND (n >= {MIN_DOCS} OR level = 2) AND (level < 2 OR f.lang = '') AND (level > 0 OR f.source = v.source)
  GROUP BY v.rid, v.measure, v.v, v.allowance),
out AS (SELECT rid FROM used WHERE v > x.hi + allowance OR v < x.lo - allowance GROUP BY rid)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND out.rid IS NULL AS kept
FROM c LEFT JOIN out USING (rid)"""


def _folded_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_folded_words('text')} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_folded_words('text')} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, size, w[i:i + size - 1] AS g
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, i, w[i:i + size - 1] AS g FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
m AS (SELECT rid, i, size, item FROM dw JOIN iw USING (size, g)),
h AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS j FROM m) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid),
-- proximity: a start from which every word of a window stands at its place or one word off it
t AS (SELECT rid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d WHERE len(w) > 0),
gs AS (SELECT g, size, row_number() OVER () AS wid FROM (SELECT DISTINCT g, size FROM iw)),
gt AS (SELECT wid, size, unnest(g) AS term, unnest(range(size)) AS i FROM gs),
df AS (SELECT term, count(*) AS n FROM t GROUP BY term),
rare AS (SELECT wid, size, arg_min(term, n * 16 + i) AS term, arg_min(i, n * 16 + i) AS i FROM gt JOIN df USING (term) GROUP BY wid, size HAVING count(*) = size),
starts AS (SELECT DISTINCT rid, wid, size, pos - i + off AS s FROM rare JOIN t USING (term), (SELECT unnest([-1, 0, 1]) AS off)),
close AS (
  SELECT DISTINCT rid, wid FROM (
    SELECT rid, wid, s FROM starts JOIN gt USING (wid, size) JOIN t USING (rid, term)
    WHERE pos BETWEEN s + i - 1 AND s + i + 1 GROUP BY rid, wid, s, size HAVING count(DISTINCT i) = size)),
kn AS (SELECT rid, count(DISTINCT item) AS n_near FROM close JOIN gs USING (wid) JOIN iw USING (g, size) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid) LEFT JOIN kn USING (rid)"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS,
    "op2_quality_rules": QUALITY,
    "op5_decontamination": CONTAMINATION,
    "op6_chat_format": chat_format.ORACLE,
    "op8_suffix_array_dedup": BYTE_SUBSTRINGS,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
