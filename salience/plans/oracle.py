"""SQL twins of the registered queries, for an independent SQL engine."""

from __future__ import annotations

import re

M = 2147483647

SAMPLES = """samples AS (
  SELECT vec_id AS sample_id, (label >= 5)::INT AS output, embedding::DOUBLE[] AS features
  FROM embeddings)"""

EXPR = """expr AS (
  SELECT sample_id, output, UNNEST(features) AS value,
         generate_subscripts(features, 1) - 1 AS feature_id
  FROM samples)"""


def fifth(x: str) -> str:
    """x^5 modulo the Mersenne prime, in 64-bit steps."""
    return f"(((({x})*({x})%{M})*(({x})*({x})%{M})%{M})*({x})%{M})"


def hashed_id(key: str, seed: int) -> str:
    return fifth(f"(({key}::BIGINT % {M}) * 48271 + {seed * 15485863 + 12345}) % {M}")


def split(seed: int = 12, share: float = 0.8) -> str:
    """CTE ``parts``: samples with is_train."""
    return f"""hashed AS (
  SELECT *, {hashed_id('sample_id', seed)} AS h FROM samples),
parts AS (
  SELECT sample_id, output, features,
         row_number() OVER (PARTITION BY output ORDER BY h, sample_id)
           <= floor(count(*) OVER (PARTITION BY output) * {share} + 0.5) AS is_train
  FROM hashed)"""


def centroid(source: str, scored: str) -> str:
    """CTEs ``weights``, ``bias`` from ``source`` and ``margins`` for ``scored``.

    Both arguments name relations (sample_id, output, features).
    """
    return f"""fit_long AS (
  SELECT output, UNNEST(features) AS value, generate_subscripts(features, 1) - 1 AS feature_id
  FROM {source}),
weights AS (
  SELECT feature_id,
         avg(value) FILTER (output = 1) - avg(value) FILTER (output = 0) AS w,
         (avg(value) FILTER (output = 1) + avg(value) FILTER (output = 0)) / 2 AS mid
  FROM fit_long GROUP BY feature_id),
bias AS (SELECT -sum(w * mid) AS b FROM weights),
long AS (
  SELECT sample_id, output, UNNEST(features) AS value,
         generate_subscripts(features, 1) - 1 AS feature_id
  FROM {scored}),
margins AS (
  SELECT sample_id, any_value(output) AS output, sum(value * w) + any_value(b) AS margin,
         1 / (1 + exp(-(sum(value * w) + any_value(b)))) AS p
  FROM long JOIN weights USING (feature_id), bias
  GROUP BY sample_id)"""


def permuted(runs: int, repeats: int, seed: int) -> str:
    """CTE ``permuted``: every value of ``long`` next to a shuffled one."""
    return f"""placed AS (
  SELECT l.*, margin, p, pos
  FROM long l JOIN (
    SELECT sample_id, margin, p,
           row_number() OVER (ORDER BY {hashed_id('sample_id', 0)}, sample_id) - 1 AS pos
    FROM margins) USING (sample_id)),
draws AS (
  SELECT run_id, repeat, n_rows, h % n_rows AS shift,
         list_filter(range(g % 1048576 + 1, g % 1048576 + 2001), lambda a: gcd(a, n_rows) = 1)[1] AS factor
  FROM (SELECT *, {fifth(f"(h * 48271 + 12345) % {M}")} AS g
        FROM (SELECT run_id, repeat, n_rows,
                     {fifth(f"(repeat * 7368787 + ({seed} + run_id) * 15485863 + 12345) % {M}")} AS h
              FROM range(1, {runs + 1}) r(run_id), range(1, {repeats + 1}) s(repeat),
                   (SELECT count(*) AS n_rows FROM margins)))),
sent AS (
  SELECT feature_id, value AS x_new, run_id, repeat, (pos * factor + shift) % n_rows AS pos
  FROM placed, draws),
permuted AS (
  SELECT t.sample_id, t.output, t.feature_id, run_id, repeat, t.margin, t.p, t.value AS x, x_new
  FROM sent JOIN placed t USING (feature_id, pos))"""


def importance(runs: int, repeats: int, seed: int) -> str:
    """CTE ``importance`` (run_id, metric, feature_id, diff)."""
    return f"""{permuted(runs, repeats, seed)},
rescored AS (
  SELECT *, 1 / (1 + exp(-(margin + w * (x_new - x)))) AS p_new
  FROM permuted JOIN weights USING (feature_id)),
spread AS (
  SELECT count(*) AS n, sum(output) - sum(output) * sum(output) / count(*) AS ss FROM margins),
drops AS (
  SELECT run_id, feature_id,
         sum(((p > 0.5)::INT = output)::INT - ((p_new > 0.5)::INT = output)::INT)::DOUBLE AS gain,
         sum((output - p_new) * (output - p_new) - (output - p) * (output - p)) AS loss
  FROM rescored GROUP BY run_id, feature_id),
importance AS (
  SELECT run_id, 'accuracy' AS metric, feature_id, gain / (n * {repeats}) AS diff FROM drops, spread
  UNION ALL
  SELECT run_id, 'r2', feature_id, loss / ss / {repeats} FROM drops, spread)"""


RANKING = """ranks AS (
  SELECT *, rank() OVER (PARTITION BY run_id, metric ORDER BY diff DESC)
            + (count(*) OVER (PARTITION BY run_id, metric, diff) - 1) / 2.0 AS rk
  FROM importance),
totals AS (
  SELECT feature_id, sum(rk)::DOUBLE AS rank_total FROM ranks GROUP BY feature_id),
ranking AS (
  SELECT feature_id, rank_total,
         1 - (rank_total - min(rank_total) OVER ())
             / nullif(max(rank_total) OVER () - min(rank_total) OVER (), 0) AS rank_fin,
         row_number() OVER (ORDER BY rank_total, feature_id) AS position
  FROM totals)"""


def flagship(runs: int, repeats: int, seed: int, n: int) -> str:
    return f"""WITH {SAMPLES}, {split()},
train AS (SELECT * FROM parts WHERE is_train),
test AS (SELECT * FROM parts WHERE NOT is_train),
{centroid('train', 'test')}, {importance(runs, repeats, seed)}, {RANKING}
SELECT feature_id::INT AS feature_id, 'g' || lpad(feature_id::VARCHAR, 2, '0') AS feature_name,
       rank_total, round(rank_fin, 6) AS rank_fin, position::INT AS position
FROM ranking WHERE position <= {n}"""


def _rounded_long(source: str) -> str:
    return f"""SELECT sample_id, output, feature_id::INT AS feature_id, round(value, 6) AS value
FROM {source}"""


BASE = f"WITH {SAMPLES}, {EXPR}, {centroid('samples', 'samples')}"


def _ranked_runs(runs: int, repeats: int) -> str:
    return f"{BASE}, {importance(runs, repeats, 100)}"


# One ranking per run: the same steps with the run as the model.
MODEL_RANKING = RANKING.replace(
    "SELECT feature_id, sum(rk)::DOUBLE AS rank_total FROM ranks GROUP BY feature_id",
    "SELECT 'm' || run_id AS model, feature_id, sum(rk)::DOUBLE AS rank_total "
    "FROM ranks GROUP BY run_id, feature_id",
).replace("OVER ()", "OVER (PARTITION BY model)").replace(
    "OVER (ORDER BY rank_total", "OVER (PARTITION BY model ORDER BY rank_total"
).replace("SELECT feature_id, rank_total,\n", "SELECT model, feature_id, rank_total,\n")

MASKS = """masks AS (
  SELECT feature_id, bit_or(CASE model WHEN 'm1' THEN 1 WHEN 'm2' THEN 2 ELSE 4 END) AS mask
  FROM ranking WHERE position <= 15 GROUP BY feature_id)"""

SUPPLIERS = """total AS (SELECT count(*) AS n_all, count(*) // 10 AS top_n FROM supplier),
numbers AS (SELECT UNNEST(range(1, 4 * n_all + 1)) AS n FROM total),
facts AS (SELECT n, sum(ln(n)) OVER (ORDER BY n) AS lf FROM numbers)"""


def _shap(value: str) -> str:
    return f"""WITH {SAMPLES}, {split()},
train AS (SELECT * FROM parts WHERE is_train),
test AS (SELECT * FROM parts WHERE NOT is_train),
{centroid('train', 'test')},
mu AS (SELECT feature_id, avg(value) AS m FROM fit_long GROUP BY feature_id),
shap AS (
  SELECT feature_id, avg({value}) AS importance
  FROM long JOIN weights USING (feature_id) JOIN mu USING (feature_id) GROUP BY feature_id)
SELECT feature_id::INT AS feature_id, round(importance, 9) AS importance,
       row_number() OVER (ORDER BY abs(importance) DESC, feature_id)::INT AS position
FROM shap"""


def areas(counts: str, keys: str) -> str:
    """CTEs ``steps`` and ``areas`` from (keys, y, score) rows."""
    return f"""grouped AS (
  SELECT {keys}, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM {counts} GROUP BY {keys}, score),
steps AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY {keys}) AS p_all, sum(neg) OVER (PARTITION BY {keys}) AS n_all
  FROM grouped
  WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
points AS (
  SELECT *, tp / (tp + fp) AS prec, tp / nullif(p_all, 0) AS rec,
         fp / nullif(n_all, 0) AS fpr,
         coalesce(lag(tp / (tp + fp)) OVER w, 1.0) AS prec0,
         coalesce(lag(tp / nullif(p_all, 0)) OVER w, 0.0) AS rec0
  FROM steps WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
ranked AS (
  SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY score)
         + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk
  FROM {counts}),
aurocs AS (
  SELECT {keys},
         (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
         / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auroc
  FROM ranked GROUP BY {keys}),
areas AS (
  SELECT {keys}, any_value(auroc) AS auroc, sum((rec - rec0) * prec) AS average_precision,
         sum((rec - rec0) * (prec + prec0) / 2) AS pr_area
  FROM points JOIN aurocs USING ({keys}) GROUP BY {keys})"""


def _sweep() -> str:
    """CTE ``mean_sweep`` (num_features, auroc, auprc)."""
    ctes = []
    for seed in (1, 2):
        text = f"""{split(seed)},
train AS (SELECT * FROM parts WHERE is_train),
test AS (SELECT * FROM parts WHERE NOT is_train),
{centroid('train', 'test')},
scores AS (
  SELECT {seed} AS sim, sample_id, output AS y, position AS num_features,
         round(sum(value * w) OVER (PARTITION BY sample_id ORDER BY position), 9) AS score
  FROM long JOIN weights USING (feature_id) JOIN ranking USING (feature_id))"""
        for name in ("hashed", "parts", "train", "test", "fit_long", "weights", "bias", "long",
                     "margins", "scores"):
            text = re.sub(rf"\b{name}\b", f"{name}_{seed}", text)
        ctes.append(text)
    return f"""{_ranked_runs(3, 5)}, {RANKING}, {ctes[0]}, {ctes[1]},
both_scores AS (SELECT * FROM scores_1 UNION ALL SELECT * FROM scores_2),
{areas('both_scores', 'sim, num_features')},
mean_sweep AS (
  SELECT num_features, avg(auroc) AS auroc, avg(average_precision) AS auprc
  FROM areas GROUP BY num_features)"""


PERFORMANCE = """performance AS (
  SELECT o_orderstatus AS dataset, strftime(o_orderdate, '%Y') AS model,
         o_orderpriority AS method, avg(o_totalprice) / 1e6 AS auroc_mean,
         stddev_pop(o_totalprice) / 1e6 AS auroc_std
  FROM orders GROUP BY ALL)"""


def _league(sort_by: str) -> str:
    return f"""WITH {PERFORMANCE},
overall AS (
  SELECT method, 'all' AS dataset, avg(auroc_mean) AS mean, avg(auroc_std) AS std
  FROM performance GROUP BY method),
per_set AS (
  SELECT method, dataset, avg(auroc_mean) AS mean, avg(auroc_std) AS std
  FROM performance GROUP BY method, dataset),
places AS (
  SELECT method, row_number() OVER (ORDER BY {sort_by} DESC, method)::INT AS place FROM overall)
SELECT place, method, dataset, round(mean, 6) AS mean, round(std, 6) AS std
FROM (SELECT * FROM overall UNION ALL SELECT * FROM per_set) JOIN places USING (method)"""


RANKING_SQL = {
    "long_explode": f"WITH {SAMPLES}, {EXPR} {_rounded_long('expr')}",
    "wide_arrays": """SELECT vec_id AS sample_id, len(embedding)::INT AS width,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda v, i: v * i)), 5) AS checksum
FROM embeddings""",
    "stratified_split": f"""WITH {SAMPLES}, {split()}
SELECT sample_id, output, is_train::INT AS is_train FROM parts""",
    "stratified_folds": f"""WITH {SAMPLES}
SELECT sample_id, output, ntile(7) OVER (PARTITION BY output ORDER BY sample_id)::INT AS fold
FROM samples""",
    "folds_unlabelled": f"""WITH {SAMPLES.replace("(label >= 5)::INT AS output", "CASE WHEN vec_id % 11 > 0 THEN (label >= 5)::INT END AS output")}, {split()}
SELECT sample_id, output, ntile(7) OVER (PARTITION BY output ORDER BY sample_id)::INT AS fold,
       is_train::INT AS is_train FROM parts""",
    "centroid_scorer": f"""{BASE}
SELECT sample_id, output, round(margin, 6) AS margin, round(p, 6) AS probability,
       (p > 0.5)::INT AS predicted FROM margins""",
    "baseline_metrics": f"""{BASE}
SELECT count(*) AS n, round(avg(((p > 0.5)::INT = output)::INT), 6) AS accuracy,
       round(1 - sum((output - p) ** 2)
               / (sum(output * output) - sum(output) ** 2 / count(*)), 6) AS r2
FROM margins""",
    "permutation_importance": f"""{_ranked_runs(3, 5)}
SELECT run_id::INT AS run_id, metric, feature_id::INT AS feature_id, round(diff, 8) AS diff
FROM importance""",
    "permutation_importance_blocks": f"""{BASE}, {importance(1, 5, 100)}
SELECT run_id::INT AS run_id, metric, feature_id::INT AS feature_id, round(diff, 8) AS diff
FROM importance""",
    "feature_ranking": flagship(4, 25, 100, 20),
    "aggregate_ranking": f"""{_ranked_runs(3, 5)}, {RANKING}
SELECT feature_id::INT AS feature_id, rank_total, round(rank_fin, 6) AS rank_fin,
       position::INT AS position FROM ranking""",
    "accuracy_ranking": f"""{_ranked_runs(3, 5)},
{RANKING.replace('FROM importance', "FROM importance WHERE metric = 'accuracy'")}
SELECT feature_id::INT AS feature_id, rank_total, round(rank_fin, 6) AS rank_fin,
       position::INT AS position FROM ranking""",
    "top_feature_projection": f"""{_ranked_runs(3, 5)}, {RANKING}
{_rounded_long('expr WHERE feature_id IN (SELECT feature_id FROM ranking WHERE position <= 5)')}""",
    "sensitivity_importance": f"""{BASE},
steps AS (
  SELECT feature_id, 0.01::DOUBLE * (max(value) - min(value)) AS step FROM long GROUP BY feature_id),
moved AS (
  SELECT feature_id, avg((p - 1 / (1 + exp(-(margin + w * step)))) ** 2) AS sensitivity
  FROM margins, weights JOIN steps USING (feature_id) GROUP BY feature_id)
SELECT feature_id::INT AS feature_id, round(sensitivity * 1e9, 3) AS sensitivity_e9,
       row_number() OVER (ORDER BY sensitivity DESC, feature_id)::INT AS position
FROM moved""",
    "linear_shap": _shap("w * (value - m)"),
    "linear_shap_abs": _shap("abs(w * (value - m))"),
    "venn_regions": f"""{_ranked_runs(3, 5)}, {MODEL_RANKING}, {MASKS}
SELECT mask, count(*) AS n_features FROM masks GROUP BY mask""",
    "venn_members": f"""{_ranked_runs(3, 5)}, {MODEL_RANKING}, {MASKS}
SELECT mask, feature_id::INT AS feature_id FROM masks WHERE mask IN (3, 5, 6, 7)""",
    "overlap_summary": f"""{_ranked_runs(3, 5)}, {MODEL_RANKING}, {MASKS}
SELECT count(*) FILTER (mask IN (3, 5, 6, 7)) AS total_overlap,
       round(3 * (15.0::DOUBLE / d) ** 2 * d, 6) AS expected_overlap
FROM masks, (SELECT max(len(embedding)) AS d FROM embeddings) GROUP BY d""",
    "log_factorial": """SELECT row_number() OVER (ORDER BY c_custkey) AS n,
  round(sum(ln(rn)) OVER (ORDER BY rn), 4) AS log_factorial
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)""",
    "overlap_probability": f"""WITH {SUPPLIERS}, zero AS (
  SELECT * FROM facts UNION ALL SELECT 0, 0),
mass AS (
  SELECT a.n AS k,
         exp(top.lf - a.lf - b.lf + a.n * ln(share) + (4 * n_all - a.n) * ln(1 - share)) AS mass
  FROM zero a
  JOIN (SELECT n_all, (top_n / n_all) ** 2 AS share FROM total) ON a.n <= n_all
  JOIN facts b ON b.n = 4 * n_all - a.n
  JOIN facts top ON top.n = 4 * n_all)
SELECT k, round(sum(mass) OVER (ORDER BY k DESC), 9) AS probability FROM mass""",
    "overlap_two_groups": f"""WITH {SUPPLIERS},
pairs AS (
  SELECT a.n AS k, top.lf - a.lf - b.lf AS choose, n_all, top_n / n_all AS share
  FROM facts a JOIN total ON a.n < n_all
  JOIN facts b ON b.n = n_all - a.n JOIN facts top ON top.n = n_all)
SELECT k, round(choose, 4) AS log_choose,
       round(choose + 2 * k * ln(share) + 2 * (n_all - k) * ln(1 - share), 4) AS log_probability
FROM pairs""",
    "average_rank": f"""{_ranked_runs(3, 5)}, {MODEL_RANKING},
mean AS (SELECT feature_id, avg(rank_fin) AS mean_rank FROM ranking GROUP BY feature_id)
SELECT feature_id::INT AS feature_id, round(mean_rank, 6) AS mean_rank,
       row_number() OVER (ORDER BY mean_rank DESC, feature_id)::INT AS position FROM mean""",
    "rank_columns": f"""{_ranked_runs(3, 5)}, {MODEL_RANKING}
SELECT feature_id::INT AS feature_id,
       round(max(rank_fin) FILTER (model = 'm1'), 6) AS m1,
       round(max(rank_fin) FILTER (model = 'm2'), 6) AS m2,
       round(max(rank_fin) FILTER (model = 'm3'), 6) AS m3
FROM ranking GROUP BY feature_id""",
    "feature_sweep": f"""{_sweep()}
SELECT num_features::INT AS num_features, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
FROM mean_sweep""",
    "sweep_cutoff": f"""{_sweep()},
best AS (SELECT max(auroc) AS best FROM mean_sweep)
SELECT 'centroid' AS model, min(num_features)::INT AS num_features,
       (min(num_features) - 1)::INT AS index, round(any_value(best), 6) AS best
FROM mean_sweep, best WHERE auroc BETWEEN best - 0.025::DOUBLE AND best + 0.025::DOUBLE""",
    "method_league": _league("mean"),
    "method_league_std": _league("std"),
    "format_parse_pm": f"""WITH {PERFORMANCE}
SELECT dataset, model, method, printf('%.4f ± %.4f', auroc_mean, auroc_std) AS auroc,
       printf('%.4f', auroc_mean)::DOUBLE AS mean, printf('%.4f', auroc_std)::DOUBLE AS std
FROM performance""",
    "square_pad": """SELECT vec_id AS sample_id, 81 AS width,
  round(list_sum(embedding::DOUBLE[]) + (label >= 5)::INT + 16, 6) AS total FROM embeddings""",
    "drop_null_subset": """SELECT o_orderkey, o_totalprice, sum(l_quantity) AS returned
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R' GROUP BY o_orderkey, o_totalprice""",
    "label_index": """SELECT c_custkey, c_mktsegment,
  dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label_index FROM customer""",
}
