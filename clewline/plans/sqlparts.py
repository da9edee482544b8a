"""Reusable pieces of the comparison SQL, written with DuckDB list and text functions."""
from __future__ import annotations

# URL rows (url_id, url) taken apart: p(url_id, url, sch, auth, ui, host, port0, st, ht).
URL_PARTS = r"""
u0 AS (SELECT url_id, trim(url) AS url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS auth FROM urls),
u1 AS (SELECT *, lower(regexp_extract(auth, '^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1)) AS h0,
  regexp_extract(auth, ':([^:\]@]*)$', 1) AS port0, regexp_extract(auth, '^(.*)@', 1) AS ui FROM u0),
u2 AS (SELECT *, list_transform(string_split(h0, '.'), lambda x: try_cast(x AS BIGINT)) AS v,
  regexp_matches(h0, '(^|\.)([0-9]+|0x[0-9a-f]*)$') AS num FROM u1),
u3 AS (SELECT *, CASE WHEN NOT num THEN NULL
  WHEN len(v) = 4 AND list_max(v) < 256 THEN v[1] * 16777216 + v[2] * 65536 + v[3] * 256 + v[4]
  WHEN len(v) = 2 AND v[1] < 256 AND v[2] < 16777216 THEN v[1] * 16777216 + v[2] END AS ipn FROM u2),
p AS (SELECT *, CASE WHEN url = '' THEN 'EMPTY_INPUT'
    WHEN sch = '' OR (sch IN ('http', 'https', 'ftp') AND h0 = '') OR (num AND ipn IS NULL)
      OR coalesce(try_cast(port0 AS BIGINT), 0) > 65535 THEN 'FAILURE' ELSE 'SUCCESS' END AS st,
  CASE WHEN ipn IS NOT NULL THEN concat_ws('.', ipn >> 24, (ipn >> 16) & 255, (ipn >> 8) & 255, ipn & 255) ELSE h0 END AS host,
  CASE WHEN h0 LIKE '[%' THEN 'IPV6' WHEN ipn IS NOT NULL THEN 'IPV4' ELSE 'DEFAULT' END AS ht,
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path0,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query0, regexp_extract(url, '#(.*)$', 1) AS frag0 FROM u3)
"""

# Query components of p: qp(url_id, pos, raw, name, value, bad).
QUERY_PARTS = r"""
q0 AS (SELECT url_id, unnest(string_split(query0, '&')) AS raw, unnest(range(len(string_split(query0, '&')))) AS pos FROM p WHERE st = 'SUCCESS' AND query0 <> ''),
q1 AS (SELECT *, CASE WHEN instr(raw, '=') > 0 THEN left(raw, instr(raw, '=') - 1) ELSE raw END AS n0,
  CASE WHEN instr(raw, '=') > 0 THEN substr(raw, instr(raw, '=') + 1) ELSE '' END AS v0,
  regexp_matches(raw, '%(?:[^0-9A-Fa-f]|[0-9A-Fa-f](?:[^0-9A-Fa-f]|$)|$)') AS bad FROM q0 WHERE raw <> ''),
qp AS (SELECT url_id, pos, raw, bad, CASE WHEN NOT bad THEN url_decode(replace(n0, '+', ' ')) END AS name,
  CASE WHEN NOT bad THEN url_decode(replace(v0, '+', ' ')) END AS value FROM q1)
"""

IS_IP = r"(host LIKE '[%' OR regexp_matches(host, '^[0-9.]+$'))"


def dom(name: str, hosts: str, sections: str = "'icann'", default: int = 0) -> str:
    """Suffix split of the hosts of a query: name(host, n, s, sub, dom, suf, reg)."""
    return rf"""
{name}_h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM ({hosts}) WHERE host IS NOT NULL),
{name}_t AS (SELECT host, len(l) AS n, k, array_to_string(list_slice(l, len(l) - k + 1, len(l)), '.') AS tail
  FROM {name}_h, range(1, 12) AS r(k) WHERE k <= len(l)),
{name}_m AS (SELECT host, n, max(CASE WHEN rule NOT LIKE '!%' THEN k END) AS c, max(CASE WHEN rule LIKE '!%' THEN k - 1 END) AS e
  FROM {name}_t LEFT JOIN (SELECT rule FROM suffix_rules WHERE section IN ({sections})) r
  ON rule = tail OR rule = '!' || tail OR (instr(tail, '.') > 0 AND rule = '*.' || substr(tail, instr(tail, '.') + 1)) GROUP BY host, n),
{name}_s AS (SELECT host, n, CASE WHEN {IS_IP} THEN -1 ELSE coalesce(e, c, {default}) END AS s, string_split(host, '.') AS l FROM {name}_m),
{name} AS (SELECT host, n, s,
  CASE WHEN s >= 0 AND n > s + 1 THEN array_to_string(list_slice(l, 1, n - s - 1), '.') ELSE '' END AS sub,
  CASE WHEN s < 0 THEN host WHEN n > s THEN l[n - s] ELSE '' END AS dom,
  CASE WHEN s > 0 THEN array_to_string(list_slice(l, n - s + 1, n), '.') ELSE '' END AS suf,
  CASE WHEN s > 0 AND n > s THEN array_to_string(list_slice(l, n - s, n), '.') ELSE '' END AS reg FROM {name}_s)
"""


def values(rows, names: str) -> str:
    """A VALUES relation from Python rows."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"
