"""SQL twins of the source and sink queries and of the tail probabilities."""

from __future__ import annotations

from salience.plans.oracle import EXPR, SAMPLES, _sweep
from salience.plans.stats_oracle import SURVIVAL, TWO_GROUPS, logrank, rank_test


def erfc(x: str) -> str:
    """Maclaurin series of the complementary error function (|x| < 4)."""
    return f"""(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 33),
      lambda k: (CASE k % 2 WHEN 0 THEN 1 ELSE -1 END) * pow({x}, 2 * k + 1)
                / (factorial(k::INT)::DOUBLE * (2 * k + 1)))))"""


def _chunks(table: str, order: str, size: str, limit: int) -> str:
    return f"""SELECT *, ((sum({size}) OVER (ORDER BY {order}) - {size}) // {limit})::BIGINT AS chunk_id
FROM {table}"""


PART_SIZE = " + ".join(
    f"length({c})" for c in (
        "p_partkey::VARCHAR", "p_name", "p_brand", "p_type", "p_size::VARCHAR",
        "p_retailprice::VARCHAR",
    )
)

SOURCE_SQL = {
    "size_chunks": f"""SELECT doc_id, chunk_id
FROM ({_chunks('documents', 'doc_id', 'length(text)', 100000)})""",
    "roundtrip_split_csv": f"""SELECT p_partkey, p_brand, p_size, p_retailprice, chunk_id
FROM ({_chunks('part', 'p_partkey', f'({PART_SIZE})', int(0.02 * 1024 * 1024))})""",
    "roundtrip_wide_csv": f"""WITH {SAMPLES}, {EXPR}
SELECT sample_id, output, 'g' || lpad(feature_id::VARCHAR, 2, '0') || '.rescaled' AS feature_name,
       round(value, 6) AS value FROM expr""",
    "roundtrip_tsv": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "roundtrip_survival": f"""WITH {SURVIVAL}
SELECT sample_id::VARCHAR AS "sampleName", survival_day, survival_event,
       CASE WHEN c_acctbal > 0 THEN (c_acctbal > 5000)::INT END AS ki67_status FROM surv""",
    "roundtrip_sweep": f"""{_sweep()}
SELECT 'centroid' AS model, num_features::INT AS num_features, round(auroc, 6) AS auroc,
       round(auprc, 6) AS auprc FROM mean_sweep""",
    "roundtrip_json": """SELECT c_name AS method, c_nationkey::VARCHAR AS nation,
  c_acctbal AS score FROM customer""",
    "observed_counts": """SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_columns
FROM embeddings""",
    "mann_whitney_p": f"""WITH {TWO_GROUPS}, {rank_test('twogroup', 'feature')}
SELECT feature, round({erfc('(abs(z) / sqrt(2))')}, 9) AS p FROM tests""",
    "log_rank_p": f"""WITH {SURVIVAL}, split AS (
  SELECT *, 1 AS one, (c_acctbal > (SELECT median(c_acctbal) FROM surv))::INT AS grp FROM surv),
{logrank('split', 'one')}
SELECT round({erfc('sqrt(chi2 / 2)')}, 9) AS p FROM lr""",
}
