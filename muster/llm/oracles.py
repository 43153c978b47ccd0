"""DuckDB SQL for the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

from muster.llm.common import LOWER, UPPER
from muster.llm.quality_rules import Rules

_RULES = Rules()

_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS n FROM places),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, range(5) AS o(k) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
by_line AS (
  SELECT r, count(*) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]'))
           - count(DISTINCT l) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) AS dup,
         coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (
           regexp_matches(l, '{_RULES.punctuation}') OR regexp_matches(l, '{_RULES.navigation}')
           OR (length(l) <= {_RULES.notice_chars} AND regexp_matches(l, '{_RULES.boilerplate}'))), 0) AS lost
  FROM lines GROUP BY r),
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{_RULES.symbols}', '', 'g')))::BIGINT AS n_symbols,
         dup::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, lost
  FROM d JOIN w USING (r) JOIN by_line USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(lost::DOUBLE / nullif(word_chars, 0), 0) <= {_RULES.most_lost} AS kept
FROM judged
"""

_OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
starts AS (SELECT item, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
           FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size),
texts AS (SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM places),
found AS (SELECT r, size, i, item FROM texts JOIN windows USING (size, w)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item COLLATE "binary") AS items
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_OP2 = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END
  FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, row_number() OVER () AS r,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                        lambda h: ('0x' || h)::UBIGINT),
                         lambda c, x: xor(c // 256, t[(xor(c, x) % 256)::INT + 1]), 4294967295::UBIGINT),
             4294967295::UBIGINT)::BIGINT AS text_crc32 FROM documents, crc_table),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32, r ROWS UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER () AS total FROM d),
c AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32, r) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard FROM c
"""

_OP7 = r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS r, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
x AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
best AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM x, rules
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM x LEFT JOIN best USING (r)
"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _op11(levels: int = 7) -> str:
    """One step per level; trees of fewer levels pass through. 7 levels reach 16**7 rows a source."""
    stored = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = " || ".join(map(_field, stored))
    lowered = " || ".join(map(_field, [*stored[:-1], f"translate(text, '{UPPER}', '{LOWER}')"]))

    def climb(at: int) -> str:
        """Runs of the nodes of step ``at``, their parents, and the rows one level higher."""
        return f"""
r{at} AS (SELECT t, i // 16 AS i, (max(n) + 15) // 16 AS n, list(h ORDER BY i) AS hs FROM n{at} WHERE n > 1 GROUP BY t, i // 16),
n{at + 1} AS (SELECT t, i, n, sha256(array_to_string(hs, '')) AS h FROM r{at} UNION ALL SELECT * FROM n{at} WHERE n = 1),
d{at + 1} AS (
  SELECT r, d.t, coalesce(r{at}.i, d.i) AS i, coalesce(r{at}.n, d.n) AS n,
         CASE WHEN hs IS NULL THEN f
              ELSE sha256(array_to_string(list_concat(hs[:d.i % 16], [f], hs[d.i % 16 + 2:]), '')) END AS f,
         CASE WHEN hs IS NULL THEN proof
              ELSE proof || array_to_string(list_concat(hs[:d.i % 16], hs[d.i % 16 + 2:]), '') END AS proof
  FROM d{at} AS d LEFT JOIN r{at} ON d.t = r{at}.t AND d.i // 16 = r{at}.i AND d.n > 1),"""

    crcs = """
steps(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END
  FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),"""
    body = "".join(map(climb, range(levels)))
    second = "".join(climb(levels + 1 + k) for k in range(levels))
    top = 2 * levels + 1
    return f"""
WITH RECURSIVE {crcs}
base AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({leaf}) AS leaf, sha256({lowered}) AS low,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
                                        lambda h: ('0x' || h)::UBIGINT),
                         lambda c, x: xor(c // 256, t[(xor(c, x) % 256)::INT + 1]), 4294967295::UBIGINT),
             4294967295::UBIGINT) % 5 = 0 AS hit FROM documents, crc_table),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n FROM base),
n0 AS (SELECT t, i, n, leaf AS h FROM placed),
d0 AS (SELECT r, t, i, n, CASE WHEN hit THEN low ELSE leaf END AS f, '' AS proof FROM placed),{body}
n{levels + 1} AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM n{levels}),
d{levels + 1} AS (SELECT r, 0 AS t, t AS i, (SELECT count(*) FROM n{levels}) AS n, f, proof FROM d{levels}),{second}
done AS (SELECT r, f, sha256(proof) AS proof_sha256 FROM d{top})
SELECT doc_id, leaf, s.h AS subroot, e.h AS root, proof_sha256, f AS folded_root, f = e.h AS verified
FROM placed JOIN n{levels} AS s USING (t) JOIN done USING (r), n{top} AS e
"""


LLM_ORACLES: dict[str, str] = {
    "op2_shards": _OP2,
    "op3_decontaminate": _OP3,
    "op7_url_filter": _OP7,
    "op10_quality_rules": _OP10,
    "op11_manifest": _op11(),
}
