"""The stages of enrichment by name: each takes (spark, directory) and gives a table."""

from __future__ import annotations

from quillspark.plans import review_queries, unit_queries

STAGES = {
    "embed": unit_queries.hashed_vectors,
    "clusters": unit_queries.cluster_fit,
    "memberships": review_queries.topic_membership,
    "labels": unit_queries.label_terms,
    "seeds": review_queries.topic_seeds,
    "converge": review_queries.topic_converged,
}
