"""SQL twins of the metric, two-group and survival queries."""

from __future__ import annotations

from salience.plans.oracle import EXPR, MODEL_RANKING, SAMPLES, _ranked_runs, areas

SCORED = """scored AS (
  SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'en' ELSE 'other' END AS dataset,
         quality AS y, n_chars::DOUBLE AS score, 1 AS one
  FROM documents JOIN labels USING (doc_id))"""

AREA_COLUMNS = """round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision,
  round(pr_area, 6) AS pr_area"""

FOLDED = """folded AS (
  SELECT *, ntile(5) OVER (PARTITION BY y ORDER BY doc_id) AS fold FROM scored)"""

SURVIVAL = """surv AS (
  SELECT c_custkey AS sample_id, any_value(c_acctbal) AS c_acctbal,
         any_value(c_mktsegment) AS c_mktsegment,
         date_diff('day', (SELECT min(o_orderdate) FROM orders), min(o_orderdate))::DOUBLE
           AS survival_day,
         (arg_min(o_orderstatus, (o_orderdate, o_orderkey)) = 'F')::INT AS survival_event
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"""

TWO_GROUPS = """twogroup AS (
  SELECT (l_returnflag = 'R')::INT AS output,
         UNNEST(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice']) AS feature,
         UNNEST([l_quantity, l_discount, l_tax, l_extendedprice]) AS value
  FROM lineitem)"""

# The normal quantile behind the two-sided 5 % gate.
CRITICAL = "1.959963984540054"


def rank_test(source: str, keys: str) -> str:
    """CTE ``tests`` (keys, n0, n1, means, u, z) from (keys, output, value)."""
    return f"""mw_ranks AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value)
            + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0::DOUBLE AS rk,
         row_number() OVER (PARTITION BY {keys}, value) AS nth,
         count(*) OVER (PARTITION BY {keys}, value)::DOUBLE AS t
  FROM {source}),
mw_sums AS (
  SELECT {keys}, count(*) FILTER (output = 0) AS n0, count(*) FILTER (output = 1) AS n1,
         avg(value) FILTER (output = 0) AS mean_0, avg(value) FILTER (output = 1) AS mean_1,
         sum(rk) FILTER (output = 0) AS r0,
         sum(t * t * t - t) FILTER (nth = 1) AS ties
  FROM mw_ranks GROUP BY {keys}),
mw_u AS (
  SELECT *, r0 - n0 * (n0 + 1) / 2 AS u, (n0 + n1)::DOUBLE AS n,
         n0::DOUBLE * n1 AS nn FROM mw_sums),
tests AS (
  SELECT *, greatest(greatest(u, nn - u) - nn / 2 - 0.5, 0)
            / nullif(sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM mw_u),
signs AS (
  SELECT *, CASE WHEN z > {CRITICAL} THEN CASE WHEN mean_1 > mean_0 THEN 1 ELSE -1 END
            ELSE 0 END AS sign FROM tests)"""


MATRIX_TESTS = f"WITH {SAMPLES}, {EXPR}, {rank_test('expr', 'feature_id')}"

MARKED = """marked AS (
  SELECT sample_id, any_value(output) AS output, sum(sign * value) AS biomarker
  FROM expr JOIN signs USING (feature_id) GROUP BY sample_id)"""


def logrank(source: str, keys: str) -> str:
    """CTE ``lr`` (keys, n0, n1, chi2) from (keys, grp, survival_day, survival_event)."""
    return f"""lr_steps AS (
  SELECT {keys}, survival_day,
         count(*) FILTER (grp = 0) AS l0, count(*) FILTER (grp = 1) AS l1,
         count(*) FILTER (grp = 0 AND survival_event = 1) AS d0,
         count(*) FILTER (survival_event = 1) AS d
  FROM {source} WHERE grp IS NOT NULL AND survival_day IS NOT NULL GROUP BY {keys}, survival_day),
lr_risk AS (
  SELECT *, sum(l0) OVER w AS n0, (sum(l0 + l1) OVER w)::DOUBLE AS n
  FROM lr_steps
  WINDOW w AS (PARTITION BY {keys} ORDER BY survival_day
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lr AS (
  SELECT {keys}, sum(l0)::BIGINT AS n0, sum(l1)::BIGINT AS n1,
         sum(d0 - d * n0 / n) ** 2
         / nullif(sum(CASE WHEN n > 1 THEN n0 * (n - n0) * d * (n - d) / (n * n * (n - 1))
                      ELSE 0 END), 0) AS chi2
  FROM lr_risk GROUP BY {keys})"""


STATS_SQL = {
    "label_metrics": f"""WITH {SCORED}, hits AS (
  SELECT *, (score > 400)::INT AS p FROM scored)
SELECT lang, round(avg((y = p)::INT), 6) AS accuracy,
       round(2 * count(*) FILTER (y = 1 AND p = 1)
             / nullif(2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y <> p), 0), 6) AS f1
FROM hits GROUP BY lang""",
    "ranking_metrics": f"""WITH {SCORED}, {areas('scored', 'lang')}
SELECT lang, {AREA_COLUMNS} FROM areas""",
    "ranking_metrics_all": f"""WITH {SCORED}, {areas('scored', 'one')}
SELECT {AREA_COLUMNS} FROM areas""",
    "line_ranking_metrics": f"""WITH lines AS (
  SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, l_extendedprice AS score FROM lineitem),
{areas('lines', 'l_linestatus')}
SELECT l_linestatus, {AREA_COLUMNS} FROM areas""",
    "curves_duo": f"""WITH {SCORED}, {areas('scored', 'dataset')}
SELECT dataset, score AS threshold, round(fpr, 6) AS fpr, round(rec, 6) AS tpr,
       round(prec, 6) AS precision, round(rec, 6) AS recall,
       round(p_all / (p_all + n_all), 6) AS baseline
FROM points""",
    "mean_roc_grid": f"""WITH {SCORED}, {FOLDED}, {areas('folded', 'fold')},
cells AS (SELECT UNNEST(range(0, 100)) AS grid),
corners AS (
  SELECT fold, fp, tp, neg, pos, p_all, n_all FROM steps
  UNION ALL SELECT DISTINCT fold, 0, 0, 0, 0, p_all, n_all FROM steps),
around AS (
  SELECT fold, grid, any_value(p_all) AS p_all, any_value(n_all) AS n_all,
         max((fp, tp)) FILTER (fp * 99 <= grid * n_all) AS lo,
         min((fp, tp)) FILTER (fp * 99 > grid * n_all) AS hi
  FROM corners, cells GROUP BY fold, grid),
curve AS (
  SELECT fold, grid,
         CASE WHEN grid = 0 THEN 0.0::DOUBLE WHEN hi IS NULL THEN 1.0::DOUBLE
         ELSE (lo[2] + (grid * n_all / 99 - lo[1]) / (hi[1] - lo[1]) * (hi[2] - lo[2])) / p_all
         END AS tpr
  FROM around),
mean AS (SELECT grid, avg(tpr) AS v FROM curve GROUP BY grid),
slices AS (SELECT *, (v + lag(v) OVER (ORDER BY grid)) / 2 / 99 AS slice FROM mean)
SELECT grid::INT AS grid, round(v, 6) AS mean_value,
       round(sum(slice) OVER (), 6) AS mean_area FROM slices""",
    "mean_pr_grid": f"""WITH {SCORED}, {FOLDED}, {areas('folded', 'fold')},
cells AS (SELECT UNNEST(range(0, 100)) AS grid),
corners AS (
  SELECT fold, tp, fp, p_all, tp / (tp + fp) AS prec FROM steps
  UNION ALL SELECT DISTINCT fold, 0, 0, p_all, 1.0::DOUBLE FROM steps),
around AS (
  SELECT fold, grid, any_value(p_all) AS p_all,
         max((tp, fp, prec)) FILTER (tp * 99 <= grid * p_all) AS lo,
         min((tp, fp, prec)) FILTER (tp * 99 > grid * p_all) AS hi
  FROM corners, cells GROUP BY fold, grid),
curve AS (
  SELECT fold, grid,
         CASE WHEN hi IS NULL THEN lo[3]
         ELSE lo[3] + (grid * p_all / 99 - lo[1]) / (hi[1] - lo[1]) * (hi[3] - lo[3])
         END AS v
  FROM around),
mean AS (SELECT grid, avg(v) AS v FROM curve GROUP BY grid),
slices AS (SELECT *, (v + lag(v) OVER (ORDER BY grid)) / 2 / 99 AS slice FROM mean)
SELECT grid::INT AS grid, round(v, 6) AS mean_value,
       round(sum(slice) OVER (), 6) AS mean_area FROM slices""",
    "feature_density": """WITH edges AS (
  SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS width
  FROM lineitem),
binned AS (
  SELECT l_returnflag, least(floor((l_extendedprice - lo) / width), 19)::INT AS bin, lo, width
  FROM lineitem, edges)
SELECT l_returnflag, bin, round(lo + bin * width, 4) AS bin_start, count(*) AS n,
       round(count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag) * width) * 1e6, 6)
         AS density_e6
FROM binned GROUP BY l_returnflag, bin, lo, width""",
    "mann_whitney": f"""WITH {TWO_GROUPS}, {rank_test('twogroup', 'feature')}
SELECT feature, n0, n1, round(u, 1) AS u, round(z, 6) AS z, round(mean_0, 4) AS mean_0,
       round(mean_1, 4) AS mean_1 FROM tests""",
    "feature_tests": f"""{MATRIX_TESTS}
SELECT feature_id::INT AS feature_id, round(u, 1) AS u, round(z, 6) AS z, sign FROM signs""",
    "group_quartiles": f"""WITH {TWO_GROUPS}, {rank_test('twogroup', 'feature')}
SELECT feature, output, round(quantile_cont(value, 0.25), 4) AS q25,
       round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75,
       round(any_value(z), 6) AS z
FROM twogroup JOIN tests USING (feature) GROUP BY feature, output""",
    "biomarker": f"""{MATRIX_TESTS}, {MARKED}
SELECT sample_id, output, round(biomarker, 6) AS biomarker FROM marked""",
    "biomarker_counts": f"""{MATRIX_TESTS}
SELECT count(*) FILTER (sign <> 0) AS significant, count(*) FILTER (sign = 1) AS over,
       count(*) FILTER (sign = -1) AS under FROM signs""",
    "kaplan_meier_gaps": f"""WITH {SURVIVAL},
steps AS (
  SELECT c_mktsegment, survival_day, count(*) FILTER (survival_event = 1) AS deaths,
         count(*) AS leaving
  FROM surv WHERE sample_id % 6 > 1 GROUP BY c_mktsegment, survival_day),
risk AS (
  SELECT *, (sum(leaving) OVER (PARTITION BY c_mktsegment ORDER BY survival_day
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS at_risk
  FROM steps)
SELECT c_mktsegment, survival_day, deaths, leaving, at_risk,
       round(product(1 - deaths / at_risk)
             OVER (PARTITION BY c_mktsegment ORDER BY survival_day ROWS UNBOUNDED PRECEDING), 6)
         AS survival
FROM risk""",
    "feature_density_gaps": """WITH edges AS (
  SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 12 AS width
  FROM lineitem WHERE l_partkey % 5 > 1),
binned AS (
  SELECT l_returnflag, least(floor((l_extendedprice - lo) / width), 11)::INT AS bin, lo, width
  FROM lineitem, edges WHERE l_partkey % 5 > 1)
SELECT l_returnflag, bin, round(lo + bin * width, 4) AS bin_start, count(*) AS n,
       round(count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag) * width) * 1e6, 6)
         AS density_e6
FROM binned GROUP BY l_returnflag, bin, lo, width""",
    "mann_whitney_gaps": f"""WITH priced AS (
  SELECT l_linestatus, (l_returnflag = 'N')::INT AS output, l_extendedprice AS value
  FROM lineitem WHERE l_partkey % 5 > 1), {rank_test('priced', 'l_linestatus')}
SELECT l_linestatus, n0, n1, round(u, 1) AS u, round(z, 6) AS z, round(mean_0, 4) AS mean_0,
       round(mean_1, 4) AS mean_1 FROM tests""",
    "log_rank_gaps": f"""WITH {SURVIVAL}, split AS (
  SELECT * FROM (
    SELECT *, 1 AS one, (c_acctbal > (SELECT median(c_acctbal) FROM surv))::INT AS grp FROM surv)
  WHERE sample_id % 6 > 1),
{logrank('split', 'one')}
SELECT n0, n1, round(chi2, 6) AS chi2 FROM lr""",
    "kaplan_meier": f"""WITH {SURVIVAL},
steps AS (
  SELECT c_mktsegment, survival_day, count(*) FILTER (survival_event = 1) AS deaths,
         count(*) AS leaving
  FROM surv GROUP BY c_mktsegment, survival_day),
risk AS (
  SELECT *, (sum(leaving) OVER (PARTITION BY c_mktsegment ORDER BY survival_day
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS at_risk
  FROM steps)
SELECT c_mktsegment, survival_day, deaths, leaving, at_risk,
       round(product(1 - deaths / at_risk)
             OVER (PARTITION BY c_mktsegment ORDER BY survival_day ROWS UNBOUNDED PRECEDING), 6)
         AS survival
FROM risk""",
    "log_rank": f"""WITH {SURVIVAL}, split AS (
  SELECT *, 1 AS one, (c_acctbal > (SELECT median(c_acctbal) FROM surv))::INT AS grp FROM surv),
{logrank('split', 'one')}
SELECT n0, n1, round(chi2, 6) AS chi2 FROM lr""",
    "log_rank_segments": f"""WITH {SURVIVAL}, split AS (
  SELECT *, (c_acctbal > median(c_acctbal) OVER (PARTITION BY c_mktsegment))::INT AS grp
  FROM surv),
{logrank('split', 'c_mktsegment')}
SELECT c_mktsegment, n0, n1, round(chi2, 6) AS chi2 FROM lr""",
    "fixed_cut_survival": f"""WITH {SURVIVAL}, split AS (
  SELECT *, 1 AS one, (c_acctbal < 0)::INT AS grp FROM surv),
{logrank('split', 'one')}
SELECT n0, n1, round(chi2, 6) AS chi2 FROM lr""",
    "biomarker_survival": f"""{MATRIX_TESTS}, {MARKED}, {SURVIVAL}
SELECT sample_id, output, round(biomarker, 6) AS biomarker, survival_day, survival_event
FROM marked LEFT JOIN surv USING (sample_id)""",
    "survival_inner": f"""WITH {SAMPLES}, {SURVIVAL}
SELECT sample_id, output, survival_day, survival_event FROM samples JOIN surv USING (sample_id)""",
    "combined_analysis": f"""{_ranked_runs(3, 5)}, {MODEL_RANKING},
{rank_test('expr', 'feature_id')}, {SURVIVAL},
marks AS (
  SELECT model, sample_id, any_value(output) AS output,
         round(sum(sign * value), 9) AS value
  FROM expr JOIN signs USING (feature_id) JOIN ranking USING (feature_id)
  WHERE position <= CASE model WHEN 'm1' THEN 10 WHEN 'm2' THEN 20 ELSE 30 END
  GROUP BY model, sample_id),
{rank_test('marks', 'model').replace('mw_', 'mk_').replace('tests', 'mark_tests')
 .replace('signs', 'mark_signs')},
split AS (
  SELECT m.*, (value > median(value) OVER (PARTITION BY model))::INT AS grp,
         survival_day, survival_event
  FROM marks m LEFT JOIN surv USING (sample_id)),
{logrank('split', 'model')}
SELECT model, round(u, 1) AS u, round(z, 6) AS z, lr.n0, lr.n1, round(chi2, 6) AS chi2
FROM mark_tests JOIN lr USING (model)""",
}
