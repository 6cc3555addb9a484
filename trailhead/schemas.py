"""Schemas of the domain tables; readers never infer them."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of the columns of each table.
DDL = {
    "chunks": """
        chunk_id string,
        file_path string,
        symbol_name string,
        symbol_kind string,
        parent_scope string,
        language string,
        content string,
        start_line int,
        end_line int,
        content_hash string,
        indexed_at bigint""",
    "file_meta": """
        file_path string,
        content_hash string,
        chunk_count int,
        language string,
        indexed_at bigint""",
    "intents": """
        id string,
        kind string,
        title string,
        description string,
        status string,
        priority string,
        criteria array<string>,
        labels array<string>,
        assigned_to string,
        created_at bigint,
        updated_at bigint""",
    "intent_edges": """
        from_id string,
        to_id string,
        kind string,
        created_at bigint""",
    "intent_locks": """
        intent_id string,
        holder string,
        worktree_id string,
        acquired_at bigint,
        expires_at bigint""",
    "eval_runs": """
        id string,
        golden_set string,
        overall_score double,
        passed boolean,
        details string,
        git_commit string,
        created_at bigint""",
    "chunk_access": """
        id bigint,
        chunk_id string,
        file_path string,
        query string,
        tool string,
        session_id string,
        worktree_id string,
        accessed_at bigint""",
    "tool_events": """
        id bigint,
        session_id string,
        tool string,
        query string,
        strategy string,
        result_count int,
        latency_ms bigint,
        groundedness_score double,
        worktree_id string,
        created_at bigint""",
    "activity": """
        timestamp bigint,
        agent string,
        path string,
        kind string""",
    "weight_snapshots": """
        id bigint,
        current struct<lexical: double, semantic: double, co_access: double, recency: double>,
        candidate struct<lexical: double, semantic: double, co_access: double, recency: double>,
        applied boolean,
        sample_size bigint,
        outcome_label string,
        candidate_delta double,
        learning_state string,
        last_learning_outcome string,
        created_at bigint""",
}

# What these columns may hold.
INTENT_KINDS = ("feature", "bug", "refactor", "spike", "test", "chore")
INTENT_STATUSES = ("draft", "approved", "in_progress", "in_review", "verified", "merged", "rejected", "blocked")
PRIORITIES = ("critical", "high", "medium", "low")
EDGE_KINDS = ("depends_on", "blocks", "implements", "tests", "related_to")


def schema(name: str) -> T.StructType:
    """The schema of a domain table; needs an active session."""
    return T.StructType.fromDDL(DDL[name])
