"""DuckDB SQL for the llm queries that SQL can express.

Written from the queries' contracts, without the operators' code. Patterns of
the rules are repeated here as literals on purpose.
"""
from __future__ import annotations

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WS})")} AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS own FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(own) FILTER (own <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (own IS NULL OR own = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (k) GROUP BY doc_id
"""

OP7 = f"""
WITH words AS (
  SELECT id, kind, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM (
    SELECT id, kind, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (
      SELECT doc_id::VARCHAR AS id, 'd' AS kind, text FROM documents
      UNION ALL SELECT item_id::VARCHAR, 'b', text FROM benchmark))),
sizes AS (SELECT DISTINCT least(n, 10) AS size FROM words WHERE kind = 'b'),
runs AS (
  SELECT id, kind, pos, size, n, string_agg(word, ' ') OVER (PARTITION BY id, kind, size ORDER BY pos
    ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS text10, word FROM words, sizes WHERE size = 10),
grams AS (
  SELECT id, kind, pos, 10 AS size, text10 AS gram FROM runs WHERE pos + 9 <= n
  UNION ALL
  SELECT w.id, w.kind, w.pos, s.size, string_agg(x.word, ' ' ORDER BY x.pos)
  FROM words w JOIN sizes s ON s.size < 10 AND w.pos + s.size - 1 <= w.n AND (w.kind = 'd' OR w.n = s.size)
  JOIN words x ON x.id = w.id AND x.kind = w.kind AND x.pos BETWEEN w.pos AND w.pos + s.size - 1
  GROUP BY w.id, w.kind, w.pos, s.size),
wins AS (SELECT DISTINCT id AS item, size, gram FROM grams WHERE kind = 'b'),
hits AS (SELECT g.id, g.pos, g.size, item FROM grams g JOIN wins USING (size, gram) WHERE g.kind = 'd'),
hit_words AS (SELECT id, count(DISTINCT p) AS n_hit FROM (
  SELECT id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY id),
hit_items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id),
counts AS (SELECT id, max(n) AS n_words FROM words WHERE kind = 'd' GROUP BY id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN counts c ON c.id = d.doc_id::VARCHAR LEFT JOIN hit_words h ON h.id = d.doc_id::VARCHAR
LEFT JOIN hit_items i ON i.id = d.doc_id::VARCHAR
"""

OP8 = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
toks AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM base)),
wins AS (SELECT doc_id, pos, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS k FROM toks
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins WHERE k = 5) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM base)),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
judged AS (
  SELECT doc_id, line, t <> '' AND (
      NOT regexp_matches(t, '[.!?:;…。！？]["''”’»)\\]]*(\\s|$)')
      OR 12 * len(regexp_extract_all(t, '[|<>{{}}=_~^\\\\#*$%&]|!!')) > length(t)
      OR (len(regexp_extract_all(t, '[|»›•·]')) >= 3
          AND length(t) < 40 * (len(regexp_extract_all(t, '[|»›•·]')) + 1))
      OR regexp_matches(t, '(?i)(^|[^\\p{{L}}])(all rights reserved|released under the|terms of (use|service)|privacy policy|cookie (policy|settings)|(we|site) uses? cookies|accept (all )?cookies|enable javascript|subscribe (now|to our)|sign (in|up)|log in|click here|read more|lorem ipsum|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|verwende[nt]+ cookies|cookies akzeptieren|javascript aktivieren|jetzt (anmelden|abonnieren)|hier klicken|weiterlesen|tous droits réservés|conditions d.utilisation|politique de confidentialité|utilis(e|ons) des cookies|accepter (tous )?les cookies|activer javascript|se connecter|cliquez ici|lire la suite|todos los derechos reservados|condiciones de uso|política de privacidad|(usa|utiliza)(mos)? cookies|aceptar (todas )?las cookies|activar javascript|iniciar sesión|haga clic aquí|leer más)($|[^\\p{{L}}])')) AS bad
  FROM (SELECT doc_id, line, trim(line, {_WS}) AS t FROM lines)),
good AS (SELECT doc_id, count(*) FILTER (bad) AS n_failed_lines,
    coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (NOT bad), 0) AS kept_chars FROM judged GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, len(regexp_extract_all(b.text, '[^\\x20\\x09-\\x0D]+')) AS n_words,
    length(regexp_replace(b.text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(b.text, '[#*$%&|<>]')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, g.n_failed_lines, g.kept_chars::BIGINT AS kept_chars
  FROM base b LEFT JOIN dups d USING (doc_id) LEFT JOIN reps r USING (doc_id) LEFT JOIN good g USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= word_chars * 0.5 AS kept
FROM counted
"""

_TWO = ("'co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.nz','co.jp','ne.jp','or.jp','com.br',"
        "'com.cn','com.mx','co.in','co.kr','co.za','com.tr','com.ar'")


def _level(name: str, units: str) -> str:
    """CTEs that shrink units (.., n, good, prior) to their priors."""
    return f"""
{name}_u AS ({units}),
{name}_s AS (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM (
  SELECT (sum(n * pow(good / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0) AS rho FROM {name}_u)),
{name} AS (SELECT u.*, prior * s + good AS a, n + s - (prior * s + good) AS b, (prior * s + good) / (n + s) AS mean FROM {name}_u u, {name}_s)"""


OP10 = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
split AS (
  SELECT page_id, url, {_LOWER.format("regexp_extract(tail, '^[^/?#]*')")} AS host,
    regexp_extract(tail, '(?s)^[^/?#]*(/[^?#]*)?', 1) AS path FROM parts),
named AS (SELECT *, string_split(host, '.') AS p, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two FROM split),
outcome AS (
  SELECT host, two, p, l.quality::DOUBLE AS good FROM named
  JOIN labels l ON l.doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[^?#]*?(\\d+)', 1) AS BIGINT) WHERE l.quality IS NOT NULL),
hosts AS (
  SELECT host, CASE WHEN two IN ({_TWO}) THEN array_to_string(list_slice(p, -3, -1), '.') ELSE two END AS domain,
    CASE WHEN two IN ({_TWO}) THEN two ELSE p[-1] END AS suffix, count(*)::DOUBLE AS n, sum(good) AS good FROM outcome GROUP BY ALL),
whole AS (SELECT sum(good) / sum(n) AS rate FROM hosts),
{_level("suf", "SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(rate) AS prior FROM hosts, whole GROUP BY suffix")},
{_level("dom", "SELECT h.domain, sum(h.n) AS n, sum(h.good) AS good, any_value(f.mean) AS prior FROM hosts h JOIN suf f USING (suffix) GROUP BY h.domain, h.suffix")},
{_level("hos", "SELECT h.host, h.n, h.good, d.mean AS prior FROM hosts h JOIN dom d USING (domain)")},
rules AS (SELECT * FROM (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')) t(rule, says)),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM split, rules
  WHERE (host = regexp_extract(rule, '^[^/]*') OR ends_with(host, '.' || regexp_extract(rule, '^[^/]*')))
    AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN coalesce(upper, CASE WHEN rate < 0.5 THEN 0 ELSE 1 END) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  level, floor(mean * 1048576 + 0.5) / 1048576 AS good_mean, floor(upper * 1048576 + 0.5) / 1048576 AS good_upper
FROM (
  SELECT s.page_id, s.host, s.path, f.rule, f.says, rate, CASE WHEN h.host IS NOT NULL THEN 'host' WHEN d.domain IS NOT NULL THEN 'domain' WHEN x.suffix IS NOT NULL THEN 'suffix' ELSE 'all' END AS level,
    coalesce(h.mean, d.mean, x.mean) AS mean, coalesce(h.mean + 1.645 * sqrt(h.a * h.b / (pow(h.a + h.b, 2) * (h.a + h.b + 1))),
      d.mean + 1.645 * sqrt(d.a * d.b / (pow(d.a + d.b, 2) * (d.a + d.b + 1))), x.mean + 1.645 * sqrt(x.a * x.b / (pow(x.a + x.b, 2) * (x.a + x.b + 1)))) AS upper
  FROM (SELECT *, CASE WHEN host = '' THEN NULL WHEN two IN ({_TWO}) THEN array_to_string(list_slice(p, -3, -1), '.') ELSE two END AS own_domain,
          CASE WHEN host = '' THEN NULL WHEN two IN ({_TWO}) THEN two ELSE p[-1] END AS own_suffix FROM named) s
  LEFT JOIN fits f USING (page_id) LEFT JOIN hos h ON h.host = s.host LEFT JOIN dom d ON d.domain = s.own_domain LEFT JOIN suf x ON x.suffix = s.own_suffix, whole)
"""

OP11 = """
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS q FROM base),
cut AS (SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 90 THEN 'plain'
    WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
made AS (SELECT *, CASE form WHEN 'plain' THEN text
  WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
  ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END AS output FROM cut),
marks AS (SELECT *, instr(output, '<P>') AS p, instr(output, '<S>') AS s, instr(output, '<M>') AS m FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
    ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, 4, p - 4) END) AS restored_sha256
FROM marks
"""

SQL = {"op11_fill_in_middle": OP11, "op6_line_dedup": OP6, "op7_decontaminate": OP7, "op8_quality_rules": OP8, "op10_url_reputation": OP10}
