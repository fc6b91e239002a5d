"""SQL text of the fixture views (FIXTURES.md part B) for DuckDB oracle queries.

The Spark side builds the same views with the DataFrame API
(``sentiscope.sources.tables``); these strings only back the oracle.
"""

from __future__ import annotations

VIEWS = {
    "posts": """
SELECT CAST(event_id AS VARCHAR) AS id,
       CAST(user_id AS VARCHAR) AS author_id,
       CAST(ts AS DATE) AS date,
       CASE WHEN event_id % 10 = 7 THEN NULL
            WHEN event_type IN ('purchase', 'signup') THEN 'positive'
            WHEN event_type IN ('view', 'click') THEN 'neutral'
            ELSE 'negative' END AS sentiment,
       CASE WHEN event_id % 10 = 7 THEN NULL
            ELSE CAST(0.5 AS DOUBLE) + CAST(event_id * 7919 % 5000 AS DOUBLE) / CAST(10000 AS DOUBLE)
       END AS confidence,
       CASE WHEN event_id % 10 <> 7 AND event_id % 17 = 0
            THEN CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS VARCHAR)
                      ELSE CONCAT(CAST(event_id % 3 AS VARCHAR), '.0') END
       END AS user_feedback
FROM events""",
    "posts_text": """
SELECT CAST(d.doc_id AS VARCHAR) AS id,
       d.source AS author_id,
       d.lang AS lang,
       d.text AS text,
       DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS date,
       CASE WHEN l.doc_id IS NULL THEN NULL
            WHEN l.toxic = 1 THEN 'negative'
            WHEN l.quality = 1 THEN 'positive'
            ELSE 'neutral' END AS sentiment
FROM documents d
LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality
           FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "predictions": """
SELECT event_id AS id, label,
       CASE WHEN event_id % 4 = 0 THEN (label + 1) % 3 ELSE label END AS pred
FROM (SELECT event_id,
             CASE WHEN event_type IN ('purchase', 'signup') THEN 2
                  WHEN event_type IN ('view', 'click') THEN 1
                  ELSE 0 END AS label
      FROM events) t""",
    "training_runs": """
SELECT ts AS start_time,
       ts + CAST(event_id % 7200 AS INT) * INTERVAL '1' SECOND AS end_time,
       value / CAST(500 AS DOUBLE) AS eval_loss,
       CASE WHEN event_id % 400 = 0 THEN NULL
            ELSE CAST(event_id % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS eval_accuracy,
       value / CAST(10 AS DOUBLE) AS eval_runtime,
       CAST(event_id % 37 AS DOUBLE) + CAST(1 AS DOUBLE) AS eval_samples_per_second,
       CAST(1 AS DOUBLE) AS epoch
FROM events""",
}


def with_views(body: str, *ctes: str, views: tuple[str, ...] = ()) -> str:
    """Prefix ``body`` with the fixture views it reads and extra named CTEs."""
    parts = [f"{v} AS ({VIEWS[v]}\n)" for v in views] + list(ctes)
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def rnd(expr: str, k: int) -> str:
    """Spark's ``round`` on a double: half up on the double's shortest decimal text
    (``8.46 * 25.0`` is 211.49999999999997 and rounds to 211; -2.375 rounds to -2.38)."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {k}) AS DOUBLE)"
