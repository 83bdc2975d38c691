"""SQL twins of queries on models that have a closed form."""

from __future__ import annotations

from salience.plans.network_oracle import NETWORK_SQL
from salience.plans.oracle import EXPR, RANKING_SQL, SAMPLES, areas, split

FOLDED = f"""{SAMPLES}, {EXPR},
folded AS (
  SELECT sample_id, output, ntile(5) OVER (PARTITION BY output ORDER BY sample_id)::INT AS fold FROM samples)"""

MODEL_SQL = {
    "general_importance": RANKING_SQL["permutation_importance"],
    "claimed_runs": RANKING_SQL["permutation_importance"],
    "roundtrip_scores": f"""WITH {SAMPLES}, {split()}
SELECT sample_id, output, 0.0::DOUBLE AS moved FROM parts WHERE NOT is_train""",
    "roundtrip_breaks": f"""WITH {SAMPLES}, {EXPR}
SELECT 'say "' || sample_id || '",' || chr(10) || chr(10) || 'not more' || chr(10) AS sample_id, output,
       'g' || feature_id || ',' || chr(10) || feature_id AS feature_name, round(value, 6) AS value
FROM expr WHERE feature_id BETWEEN CASE WHEN sample_id % 3 > 0 THEN 0 ELSE 12 END
                               AND CASE WHEN sample_id % 3 > 0 THEN 23 ELSE 35 END""",
    "general_change": NETWORK_SQL["prediction_change"],
    "general_sensitivity": f"""SELECT feature_id, sensitivity_e9
FROM ({RANKING_SQL["sensitivity_importance"]})""",
    "fold_optimum": f"""WITH {FOLDED}
SELECT fold, (SELECT count(*) FROM folded) - count(*) AS n, 0.0::DOUBLE AS slope FROM folded GROUP BY fold""",
    "fold_evaluation_centroid": f"""WITH {FOLDED},
sums AS (
  SELECT fold, e.output, feature_id, sum(value) AS s, count(*) AS n
  FROM expr e JOIN folded USING (sample_id) GROUP BY ALL),
means AS (
  SELECT f.fold, s.output, feature_id, sum(s) / sum(n) AS mean
  FROM sums s JOIN (SELECT DISTINCT fold FROM folded) f ON f.fold <> s.fold GROUP BY ALL),
fitted AS (
  SELECT fold, feature_id, max(mean) FILTER (output = 1) - max(mean) FILTER (output = 0) AS w,
         (max(mean) FILTER (output = 1) + max(mean) FILTER (output = 0)) / 2 AS mid
  FROM means GROUP BY fold, feature_id),
scored AS (
  SELECT fold, sample_id, any_value(e.output) AS y, sum(w * (value - mid)) AS score
  FROM expr e JOIN folded USING (sample_id) JOIN fitted USING (fold, feature_id) GROUP BY fold, sample_id),
hard AS (
  SELECT fold, avg(((score > 0)::INT = y)::INT) AS accuracy,
         2 * count(*) FILTER (score > 0 AND y = 1) / (count(*) FILTER (score > 0) + count(*) FILTER (y = 1)) AS f1
  FROM scored GROUP BY fold),
{areas('scored', 'fold')},
every AS (SELECT fold, accuracy, f1, auroc, average_precision FROM hard JOIN areas USING (fold))
SELECT 'fold' AS part, fold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(auroc, 6) AS auroc,
       round(average_precision, 6) AS average_precision FROM every
UNION ALL SELECT 'mean', NULL, round(avg(accuracy), 6), round(avg(f1), 6), round(avg(auroc), 6),
       round(avg(average_precision), 6) FROM every
UNION ALL SELECT 'std', NULL, round(stddev_pop(accuracy), 6), round(stddev_pop(f1), 6),
       round(stddev_pop(auroc), 6), round(stddev_pop(average_precision), 6) FROM every""",
}
