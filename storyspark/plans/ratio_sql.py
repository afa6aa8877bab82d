"""The matching-block ratio of two texts as SQL, for checks: longest common block, then both sides of it, and so on."""

from __future__ import annotations


def ratio_ctes(pairs: str, out: str) -> str:
    """CTEs after which ``out(a, b, ratio)`` holds the ratio of every different pair of ``pairs(a, b)``.

    A run is a diagonal on which characters agree. A block is sought among runs of characters that are not popular in a long
    second text, leftmost in the first text and then in the second, and widened over popular ones.
    """
    p = out
    return f"""{p}_p AS MATERIALIZED (SELECT *, row_number() OVER () AS pid FROM (SELECT DISTINCT a, b FROM {pairs})),
{p}_a AS (SELECT pid, i, substr(a, i + 1, 1) AS c FROM (SELECT pid, a, unnest(range(length(a))) AS i FROM {p}_p)),
{p}_b AS (SELECT pid, j, n, substr(b, j + 1, 1) AS c FROM (SELECT pid, b, length(b) AS n, unnest(range(length(b))) AS j FROM {p}_p)),
{p}_u AS (SELECT pid, c FROM {p}_b WHERE n >= 200 GROUP BY pid, c, n HAVING count(*) > n // 100 + 1),
{p}_c AS MATERIALIZED (SELECT x.pid, i, i - j AS g, u.c IS NULL AS rare FROM {p}_a x JOIN {p}_b y ON x.pid = y.pid AND x.c = y.c LEFT JOIN {p}_u u ON u.pid = x.pid AND u.c = x.c),
{p}_f AS MATERIALIZED (SELECT pid, g, min(i) AS s, max(i) AS e FROM (SELECT pid, g, i, i - row_number() OVER (PARTITION BY pid, g ORDER BY i) AS k FROM {p}_c) GROUP BY pid, g, k),
{p}_r AS MATERIALIZED (SELECT pid, g, min(i) AS s, max(i) AS e FROM (SELECT pid, g, i, i - row_number() OVER (PARTITION BY pid, g ORDER BY i) AS k FROM {p}_c WHERE rare) GROUP BY pid, g, k),
{p}_w(pid, al, ah, bl, bh, got) AS (
  SELECT pid, 0::BIGINT, length(a), 0::BIGINT, length(b), 0::BIGINT FROM {p}_p
  UNION ALL
  SELECT pid, CASE side WHEN 0 THEN al ELSE e + 1 END, CASE side WHEN 0 THEN s ELSE ah END, CASE side WHEN 0 THEN bl ELSE e + 1 - g END,
    CASE side WHEN 0 THEN s - g ELSE bh END, CASE side WHEN 0 THEN e - s + 1 ELSE 0 END
  FROM (SELECT m.pid, m.al, m.ah, m.bl, m.bh, m.g, greatest(f.s, m.al, m.bl + m.g) AS s, least(f.e, m.ah - 1, m.bh - 1 + m.g) AS e FROM (
      SELECT pid, al, ah, bl, bh, coalesce(-best[3], al - bl) AS g, coalesce(best[2], al) AS at FROM (
        SELECT w.pid, w.al, w.ah, w.bl, w.bh, min([greatest(r.s, w.al, w.bl + r.g) - 1 - least(r.e, w.ah - 1, w.bh - 1 + r.g), greatest(r.s, w.al, w.bl + r.g), -r.g])
          FILTER (WHERE least(r.e, w.ah - 1, w.bh - 1 + r.g) >= greatest(r.s, w.al, w.bl + r.g)) AS best
        FROM {p}_w w LEFT JOIN {p}_r r ON r.pid = w.pid WHERE w.ah > w.al AND w.bh > w.bl GROUP BY w.pid, w.al, w.ah, w.bl, w.bh)) m
    JOIN {p}_f f ON f.pid = m.pid AND f.g = m.g AND f.s <= m.at AND f.e >= m.at) z, (SELECT unnest([0, 1]) AS side)),
{out} AS MATERIALIZED (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * m / (length(a) + length(b)) END AS ratio
  FROM {p}_p JOIN (SELECT pid, sum(got) AS m FROM {p}_w GROUP BY pid) USING (pid))"""
