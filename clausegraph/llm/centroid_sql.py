"""SQL of the centroid clustering query: ten rounds written out, in integers."""

from __future__ import annotations

_DISTANCE = "list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) FOR i IN range(1, 65)])"


def _assigned(name: str, centroids: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT rid, vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.rid, v.vec_id, v.x, c.c, {_DISTANCE}::BIGINT AS d FROM v CROSS JOIN {centroids} c)
  GROUP BY rid, vec_id, x)"""


def _moved(name: str, assigned: str, before: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT c, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
    FROM (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)
    GROUP BY c) m USING (c))"""


def centroid_sql(rounds: int = 10, clusters: int = 8, seed: int = 3) -> str:
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters}))""",
    ]
    for k in range(rounds):
        parts += [_assigned(f"a{k}", f"c{k}"), _moved(f"c{k + 1}", f"a{k}", f"c{k}")]
    parts.append(_assigned("a", f"c{rounds}"))
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a JOIN c{rounds} f ON f.c = a.c
"""
