"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bt_rank, crc_select, decontam, fim_capture, line_runs, ngram_join, pii_crf, pst, quality_ngram, quote_link, soft_mix, toxicity_fm, url_filter
from .common import read


def _docs_labels(op):
    return lambda spark, sf_dir: op(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _docs(op):
    return lambda spark, sf_dir: op(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_redirect_equivalence": lambda spark, sf_dir: url_filter.op1(spark, read(spark, sf_dir, "pages")),
    "op2_spaced_seeds": lambda spark, sf_dir: decontam.op2(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op3_toxicity_fm": _docs_labels(toxicity_fm.op3),
    "op4_quality_ngram": _docs_labels(quality_ngram.op4),
    "op5_quote_link": lambda spark, sf_dir: quote_link.op5(read(spark, sf_dir, "conversations")),
    "op6_suffix_tree": _docs(pst.op6),
    "op7_soft_mix": _docs_labels(soft_mix.op7),
    "op8_bradley_terry": _docs_labels(bt_rank.op8),
    "op9_ngram_join": _docs(ngram_join.op9),
    "op10_pii_crf": _docs(pii_crf.op10),
    "op11_crc_resampling": lambda spark, sf_dir: crc_select.op11(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op12_line_runs": _docs(line_runs.op12),
    "op13_fill_in_middle": _docs(fim_capture.op13),
}
SQL: dict[str, str] = {
    "op1_redirect_equivalence": r"""
WITH RECURSIVE rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, rest, translate(regexp_extract(rest, '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT host || path || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS src, host, unnest([
        regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
        regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
      ]) AS link FROM p),
d AS (SELECT src, replace(CASE WHEN contains(link, '://') THEN substr(link, instr(link, '://') + 3)
        WHEN starts_with(link, '//') THEN substr(link, 3) WHEN starts_with(link, '/') THEN host || link
        ELSE regexp_extract(src, '^([^?]*/)', 1) || link END, '&amp;', '&') AS dst FROM l WHERE link <> ''),
n AS (SELECT src AS x, translate(regexp_extract(dst, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || regexp_extract(dst, '^[^/?#]*([^#]*)', 1) AS y FROM d),
e AS (SELECT x, y FROM n UNION SELECT y, x FROM n),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT b, arg_max(action, length(rhost || rpath)) AS action FROM (SELECT DISTINCT b FROM r) JOIN rules
      ON (regexp_extract(b, '^[^/?]*') = rhost OR ends_with(regexp_extract(b, '^[^/?]*'), '.' || rhost))
      AND starts_with(regexp_extract(b, '^[^/?]*([^?]*)', 1), rpath) GROUP BY b),
k AS (SELECT r.a, bool_or(m.action = 'allow') AS al, bool_or(m.action = 'block') AS bl FROM r JOIN m ON r.b = m.b GROUP BY r.a),
j AS (SELECT p.page_id, p.host, p.path, p.host || p.path || regexp_extract(p.rest, '^[^?#]*(\?[^#]*)', 1) AS node,
        (SELECT struct_pack(rule := rhost || rpath, action := action) FROM rules
         WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
         ORDER BY length(rhost || rpath) DESC LIMIT 1) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.action, CASE WHEN al THEN 'allow' WHEN bl THEN 'block' END, 'allow') AS verdict,
  CASE WHEN best IS NOT NULL THEN 'rule' WHEN al OR bl THEN 'alias' ELSE 'default' END AS via
FROM j LEFT JOIN k ON j.node = k.a AND j.host <> ''
""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM g WHERE len(sh) > 0 GROUP BY list_sort(sh)),
s AS (SELECT rep, len(sh) AS n, unnest(sh) AS h FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM s a JOIN s b ON a.h = b.h AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
k AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT g.doc_id, len(g.sh)::BIGINT AS n_shingles, coalesce(k.component_id, g.doc_id) AS component_id
FROM g LEFT JOIN c ON list_sort(g.sh) = c.sh LEFT JOIN k ON k.rep = c.rep
""",
    "op11_crc_resampling": r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
         lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
src AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT row_number() OVER () AS rid, side, id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
f AS (SELECT rid, side, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: array_to_string(ws[i:i + 1], ' ')),
         list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: array_to_string(ws[i:i + 2], ' ')))) AS feat FROM w),
n AS (SELECT rid, side, feat, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT feat, hex(encode(feat)) AS h FROM (SELECT DISTINCT feat FROM n)),
b AS (SELECT feat, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
         lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
nb AS (SELECT n.*, b.bucket FROM n JOIN b USING (feat)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM nb GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM c),
g AS (SELECT bucket, floor(1000 * ln(((t::DOUBLE + 1) * (ss + 10000)) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain FROM c, tot),
d AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM nb JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
sc AS (SELECT w.id AS doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE)
         / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (rid) WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r,
         count(*) OVER (PARTITION BY words >= 20) AS eligible FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 5 * eligible // 100 THEN r END AS rank FROM r
""",
    "op12_line_runs": r"""
WITH l AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id <> r.top, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY rid
""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, x, n, CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM f
""",
}
