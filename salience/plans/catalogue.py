"""All registered queries and their SQL twins."""

from __future__ import annotations

from salience.plans import (
    model_oracle, model_queries, network_oracle, network_queries, oracle, ranking_queries, reduction_oracle,
    source_oracle, source_queries, stats_oracle, stats_queries,
)

QUERIES = {
    **ranking_queries.QUERIES,
    **stats_queries.QUERIES,
    **network_queries.QUERIES,
    **source_queries.QUERIES,
    **model_queries.QUERIES,
}
ORACLE = {
    **oracle.RANKING_SQL,
    **stats_oracle.STATS_SQL,
    **network_oracle.NETWORK_SQL,
    **source_oracle.SOURCE_SQL,
    **model_oracle.MODEL_SQL,
    **reduction_oracle.REDUCTION_SQL,
}
