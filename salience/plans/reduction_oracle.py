"""SQL twins of the reducers: eigenvectors of the Gram matrix by repeated squaring."""

from salience.plans.oracle import EXPR, SAMPLES

#: Squarings; the matrix is raised to 2 to this power.
SQUARINGS = 16


def _component(k: int) -> str:
    """CTEs that take the leading eigenvector off ``g{k}`` and leave ``g{k + 1}``."""
    steps = [f"p{k}_0 AS MATERIALIZED (SELECT i, j, s / (SELECT sum(s) FROM g{k} WHERE i = j) AS s FROM g{k})"]
    for n in range(SQUARINGS):
        steps.append(f"""q{k}_{n} AS MATERIALIZED (
  SELECT a.i, b.j, sum(a.s * b.s) AS s FROM p{k}_{n} a JOIN p{k}_{n} b ON a.j = b.i GROUP BY ALL),
p{k}_{n + 1} AS MATERIALIZED (SELECT i, j, s / (SELECT sum(s) FROM q{k}_{n} WHERE i = j) AS s FROM q{k}_{n})""")
    steps.append(f"""v{k} AS MATERIALIZED (
  SELECT i, s / sqrt(sum(s * s) OVER ()) AS x FROM p{k}_{SQUARINGS}
  WHERE j = (SELECT i FROM p{k}_{SQUARINGS} WHERE i = j ORDER BY s DESC, i LIMIT 1)),
l{k} AS MATERIALIZED (
  SELECT sum(a.x * s * b.x) AS l FROM g{k} JOIN v{k} a USING (i) JOIN v{k} b ON b.i = g{k}.j),
g{k + 1} AS MATERIALIZED (
  SELECT g{k}.i, g{k}.j, s - l * a.x * b.x AS s FROM g{k} JOIN v{k} a USING (i) JOIN v{k} b ON b.i = g{k}.j, l{k})""")
    return ",\n".join(steps)


def components(count: int, centred: bool) -> str:
    """component, feature_id, loading and variance of the leading components."""
    shift = "value - avg(value) OVER (PARTITION BY feature_id)" if centred else "value"
    found = " UNION ALL ".join(
        f"""SELECT {k}::INT AS component, i::INT AS feature_id,
  round(x * sign(max_by(x, abs(x)) OVER ()), 6) AS loading, round((SELECT l FROM l{k}), 6) AS variance FROM v{k}"""
        for k in range(count))
    return f"""WITH {SAMPLES}, {EXPR},
cells AS (SELECT sample_id, feature_id, {shift} AS x FROM expr),
g0 AS MATERIALIZED (
  SELECT a.feature_id AS i, b.feature_id AS j, sum(a.x * b.x) AS s
  FROM cells a JOIN cells b USING (sample_id) GROUP BY ALL),
{", ".join(_component(k) for k in range(count))}
{found}"""


REDUCTION_SQL = {"pca_components": components(2, True), "svd_components": components(3, False)}
