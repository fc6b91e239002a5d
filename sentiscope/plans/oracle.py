"""DuckDB oracle SQL for each registered query (same column names as the Spark side).

Conventions: counts cast to BIGINT (DuckDB sums are HUGEINT), rounding through
DECIMAL (``rnd``) so ties go the way Spark's ``round`` sends them, and every
top-k has a unique last sort key.
"""

from __future__ import annotations

from ..functions import bands as B
from ..operators.naive_bayes import SETTINGS
from . import params as P
from .oracle_views import rnd, with_views

SQL: dict[str, str] = {}

W0, W1, W2 = 2.0, 1.0, 3.0


def band_sql(expr: str, steps, below: str = "red") -> str:
    out = f"'{below}'"
    for lo, name in steps:
        out = f"CASE WHEN {expr} >= {float(lo)} THEN '{name}' ELSE {out} END"
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE {out} END"


def index_sql(p: str, n: str, g: str) -> str:
    total = f"({p} + {n} + {g})"
    raw = (f"(CAST({p} AS DOUBLE) * {W0} + CAST({n} AS DOUBLE) * {W1} - CAST({g} AS DOUBLE) * {W2})"
           f" / CAST({total} AS DOUBLE)")
    return f"CASE WHEN {total} > 0 THEN {rnd(raw, 2)} ELSE CAST(0 AS DOUBLE) END"


DAILY_CTE = f"""daily AS (
  SELECT date, positive_count, negative_count, neutral_count,
         {index_sql('positive_count', 'neutral_count', 'negative_count')} AS reputation_index
  FROM (SELECT date,
               CAST(count_if(sentiment = 'positive') AS BIGINT) AS positive_count,
               CAST(count_if(sentiment = 'negative') AS BIGINT) AS negative_count,
               CAST(count_if(sentiment = 'neutral') AS BIGINT) AS neutral_count
        FROM posts WHERE date IS NOT NULL GROUP BY date) c
)"""

RANGE = f"date BETWEEN DATE '{P.DAY_LO}' AND DATE '{P.DAY_HI}'"
RUN_RANGE = (f"start_time BETWEEN TIMESTAMP '{P.RUN_LO}' AND TIMESTAMP '{P.RUN_HI}'")


def text_sql(body: str, *ctes: str) -> str:
    return with_views(body, *ctes, views=("posts_text",))


def posts_sql(body: str, *ctes: str) -> str:
    return with_views(body, *ctes, views=("posts",))


def daily_sql(body: str) -> str:
    return with_views(body, DAILY_CTE, views=("posts",))


def runs_sql(body: str) -> str:
    return with_views(body, views=("training_runs",))


SQL["daily_reputation"] = daily_sql("SELECT * FROM daily")
SQL["daily_reputation_closed"] = daily_sql(
    "SELECT * FROM daily WHERE date < (SELECT max(date) FROM daily)")
SQL["counts_by_day_class"] = posts_sql(
    "SELECT date, sentiment, CAST(count(*) AS BIGINT) AS count FROM posts GROUP BY date, sentiment")
SQL["class_counts_pivot"] = posts_sql("""
SELECT date,
       CAST(count_if(sentiment = 'positive') AS BIGINT) AS positive_count,
       CAST(count_if(sentiment = 'negative') AS BIGINT) AS negative_count,
       CAST(count_if(sentiment = 'neutral') AS BIGINT) AS neutral_count
FROM posts WHERE date IS NOT NULL GROUP BY date""")
SQL["weights_from_text"] = posts_sql(f"""
SELECT date, CAST({W0} AS DOUBLE) AS w_positive, CAST({W1} AS DOUBLE) AS w_neutral,
       CAST({W2} AS DOUBLE) AS w_negative, {index_sql('p', 'n', 'g')} AS reputation_index
FROM (SELECT date, count_if(sentiment = 'positive') AS p, count_if(sentiment = 'neutral') AS n,
             count_if(sentiment = 'negative') AS g
      FROM posts WHERE date IS NOT NULL GROUP BY date) c""")

SQL["scan_posts"] = posts_sql(
    f"SELECT id, date, sentiment, confidence FROM posts WHERE {RANGE} AND sentiment IS NOT NULL")
SQL["first_posts"] = posts_sql("SELECT id, date, sentiment FROM posts ORDER BY id LIMIT 5")
SQL["sorted_counts"] = posts_sql("""
SELECT date, sentiment, count, row_number() OVER (ORDER BY date NULLS FIRST, sentiment NULLS FIRST) AS position
FROM (SELECT date, sentiment, CAST(count(*) AS BIGINT) AS count FROM posts GROUP BY date, sentiment) c""")
SQL["schema_check"] = "SELECT 8 AS columns, 8 AS expected, true AS matches, CAST(count(*) AS BIGINT) AS rows FROM events"
SQL["pending_posts"] = posts_sql("SELECT id, author_id, date FROM posts WHERE sentiment IS NULL")
SQL["posts_in_range"] = posts_sql(f"SELECT id, date, sentiment FROM posts WHERE {RANGE}")
SQL["posts_last_30_days"] = posts_sql("""
SELECT date, CAST(count(*) AS BIGINT) AS count FROM posts
WHERE date >= (SELECT max(date) FROM posts) - INTERVAL 30 DAY AND date <= (SELECT max(date) FROM posts)
GROUP BY date""")
SQL["posts_last_7_days"] = posts_sql(f"""
SELECT id, date, sentiment FROM posts
WHERE date >= (SELECT max(date) FROM posts) - INTERVAL {P.LAST_DAYS} DAY AND date <= (SELECT max(date) FROM posts)""")
SQL["epoch_ms"] = posts_sql("SELECT id, date, epoch_ms(CAST(date AS TIMESTAMP)) AS epoch_ms FROM posts")

SQL["post_count_in_range"] = posts_sql(f"""
SELECT post_count, {band_sql('post_count', B.POST_COUNT_STEPS)} AS count_band
FROM (SELECT CAST(count(*) AS BIGINT) AS post_count FROM posts WHERE {RANGE}) t""")
SQL["class_counts_in_range"] = posts_sql(
    f"SELECT sentiment, CAST(count(*) AS BIGINT) AS count FROM posts WHERE {RANGE} GROUP BY sentiment")
SQL["posts_per_day"] = posts_sql(
    f"SELECT date, CAST(count(*) AS BIGINT) AS count FROM posts WHERE {RANGE} GROUP BY date")
SQL["reputation_series"] = daily_sql(f"""
SELECT date, reputation_index, epoch_ms(CAST(date AS TIMESTAMP)) AS epoch_ms,
       {band_sql('reputation_index', B.DAILY_INDEX_STEPS)} AS index_band
FROM daily WHERE {RANGE}""")
SQL["mean_reputation_in_range"] = daily_sql(f"""
SELECT {rnd('avg(reputation_index)', 6)} AS mean_reputation_index, CAST(count(*) AS BIGINT) AS days
FROM daily WHERE {RANGE}""")
SQL["mean_confidence_in_range"] = posts_sql(f"""
SELECT {rnd('avg(confidence)', 6)} AS mean_confidence, CAST(count(confidence) AS BIGINT) AS scored_posts
FROM posts WHERE {RANGE}""")
_ipct = f"((m - ({-W2})) / ({B.INDEX_MAX} - ({-W2})) * 100.0)"
SQL["reputation_bands"] = posts_sql(f"""
SELECT {rnd('m', 6)} AS mean_reputation_index,
       {rnd(_ipct, 4)} AS index_percent,
       {band_sql(_ipct, B.INDEX_PERCENT_STEPS)} AS index_band,
       {rnd('c', 6)} AS mean_confidence,
       {rnd('c * 100.0', 4)} AS confidence_percent,
       {band_sql('(c * 100.0)', B.CONFIDENCE_PERCENT_STEPS)} AS confidence_band
FROM (SELECT (SELECT avg(reputation_index) FROM daily) AS m,
             (SELECT avg(confidence) FROM posts WHERE {RANGE}) AS c) t""",
    DAILY_CTE.replace("WHERE date IS NOT NULL", f"WHERE date IS NOT NULL AND {RANGE}"))
SQL["latest_negative"] = text_sql(f"""
SELECT author_id, date, text, id FROM posts_text WHERE sentiment = 'negative' AND {RANGE}
ORDER BY date DESC, id ASC LIMIT {P.TOP_NEGATIVE}""")
SQL["sample_posts"] = text_sql(f"SELECT id, text, sentiment FROM posts_text WHERE {RANGE}")

_renames = ", ".join([
    'start_time AS "Start time"', 'end_time AS "End Time"', 'eval_loss AS "Loss Evaluation"',
    'eval_accuracy AS "Accuracy Evaluation"', 'eval_runtime AS "Evaluation runtime"',
    'eval_samples_per_second AS "Evaluation sample/s"', 'epoch AS "Epochs"'])
SQL["latest_training_runs"] = runs_sql(f"""
SELECT {_renames} FROM training_runs WHERE {RUN_RANGE}
ORDER BY start_time DESC, end_time DESC LIMIT {P.TOP_RUNS}""")
SQL["sorted_training_runs"] = runs_sql(f"""
SELECT row_number() OVER (ORDER BY eval_samples_per_second, start_time DESC) AS position, start_time, eval_samples_per_second AS speed
FROM (SELECT * FROM training_runs WHERE {RUN_RANGE} ORDER BY start_time DESC, end_time DESC LIMIT {P.TOP_RUNS}) t""")
SQL["last_training_run"] = runs_sql(f"""
SELECT * FROM training_runs WHERE {RUN_RANGE} ORDER BY start_time DESC, end_time DESC LIMIT 1""")
SQL["last_accuracy"] = runs_sql(f"""
SELECT last_accuracy, "at", {band_sql('last_accuracy', B.ACCURACY_STEPS)} AS accuracy_band
FROM (SELECT eval_accuracy AS last_accuracy, start_time AS "at" FROM training_runs
      WHERE {RUN_RANGE} AND eval_accuracy IS NOT NULL
      ORDER BY start_time DESC, end_time DESC, eval_accuracy DESC LIMIT 1) t""")
SQL["accuracy_bands"] = runs_sql(f"""
SELECT start_time, eval_accuracy, {band_sql('eval_accuracy', B.ACCURACY_STEPS)} AS accuracy_band
FROM training_runs WHERE {RUN_RANGE}""")
SQL["run_metric_series"] = runs_sql(f"""
SELECT start_time, eval_loss, eval_accuracy, eval_samples_per_second,
       CAST(epoch_us(start_time) // 1000 AS BIGINT) AS epoch_ms
FROM training_runs WHERE {RUN_RANGE}""")
SQL["train_seconds"] = runs_sql(f"""
SELECT start_time, CAST(epoch(date_trunc('second', end_time)) - epoch(date_trunc('second', start_time)) AS BIGINT)
       AS train_seconds
FROM training_runs WHERE {RUN_RANGE}""")


# ---- evaluation --------------------------------------------------------------------

def pred_sql(body: str, *ctes: str) -> str:
    return with_views(body, *ctes, views=("predictions",))



NAMES = "['negative', 'neutral', 'positive']"


def name_sql(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 2 THEN {NAMES}[{x} + 1] END"


SQL["accuracy"] = pred_sql(
    "SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, "
    "CAST(count(*) AS BIGINT) AS n FROM predictions")
SQL["macro_f1"] = pred_sql(f"""
SELECT {rnd('avg(f1)', 6)} AS macro_f1, CAST(count(*) AS BIGINT) AS classes
FROM (SELECT c.cls,
             CASE WHEN s.support + s.predicted > 0 THEN 2.0 * s.tp / (s.support + s.predicted) ELSE 0.0 END AS f1
      FROM (SELECT label AS cls FROM predictions UNION SELECT pred FROM predictions) c
      JOIN (SELECT cls, sum(tp)::DOUBLE AS tp, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted
            FROM (SELECT label AS cls, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 1 AS support, 0 AS predicted
                  FROM predictions
                  UNION ALL
                  SELECT pred, 0, 0, 1 FROM predictions) u GROUP BY cls) s ON c.cls = s.cls) t""")
SQL["confusion_matrix"] = pred_sql(f"""
SELECT label, pred, {name_sql('label')} AS label_name, {name_sql('pred')} AS pred_name, n,
       {rnd('CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE)', 6)} AS share
FROM (SELECT label, pred, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY label, pred) c""")
SQL["misclassified"] = pred_sql(f"""
SELECT id, label, pred, {name_sql('label')} AS label_name, {name_sql('pred')} AS pred_name
FROM predictions WHERE label <> pred ORDER BY id LIMIT 10""")
SQL["misclassified_all"] = SQL["misclassified"].replace(" ORDER BY id LIMIT 10", "")
SQL["misclassification_rate"] = pred_sql(f"""
SELECT wrong, total, {rnd('100.0 * wrong / total', 2)} AS wrong_percent
FROM (SELECT CAST(count_if(label <> pred) AS BIGINT) AS wrong, CAST(count(*) AS BIGINT) AS total FROM predictions) t""")

# ---- labels and splits ---------------------------------------------------------------

LABEL_CASE = """CASE coalesce(user_feedback, sentiment)
    WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2
    WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2
    WHEN '0.0' THEN 0 WHEN '1.0' THEN 1 WHEN '2.0' THEN 2 END"""
LABELS_CTE = f"""labels_ AS (
  SELECT id, label FROM (SELECT id, {LABEL_CASE} AS label FROM posts WHERE sentiment IS NOT NULL) t
  WHERE label IS NOT NULL)"""
def split_cte(name: str, stratum: str | None = None) -> str:
    """Exact seeded split; with ``stratum`` the rank and the cut are per class."""
    over = f"PARTITION BY {stratum} " if stratum else ""
    return f"""{name} AS (
  SELECT id, label,
         CASE WHEN rk <= t THEN 'test' WHEN rk <= t + v THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT id, label, rk, t, ceil(CAST({P.VALIDATION_SHARE} AS DOUBLE) * (CAST(n AS DOUBLE) - t)) AS v
        FROM (SELECT id, label, rk, n, ceil(CAST({P.TEST_SHARE} AS DOUBLE) * CAST(n AS DOUBLE)) AS t
              FROM (SELECT id, label,
                           row_number() OVER ({over}ORDER BY md5(id || '{P.SPLIT_SEED}'), id) AS rk,
                           count(*) OVER ({over.strip()}) AS n
                    FROM labels_) a) b) c)"""


SPLIT_CTE = split_cte("split_")


def split_sql(body: str) -> str:
    return with_views(body, LABELS_CTE, SPLIT_CTE, views=("posts",))


SQL["training_labels"] = with_views("SELECT id, label FROM labels_", LABELS_CTE, views=("posts",))
SQL["train_val_test_split"] = split_sql("SELECT id, label, split FROM split_")
SQL["stratified_split"] = with_views("SELECT id, label, split FROM strat_", LABELS_CTE,
                                     split_cte("strat_", "label"), views=("posts",))
SQL["split_sizes"] = split_sql(
    "SELECT split, CAST(count(*) AS BIGINT) AS n FROM split_ GROUP BY ROLLUP (split)")
SQL["split_class_counts"] = split_sql(
    "SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM split_ GROUP BY split, label")
SQL["distribution_matrix"] = split_sql("""
SELECT label,
       CAST(count_if(split = 'train') AS BIGINT) AS train,
       CAST(count_if(split = 'validation') AS BIGINT) AS validation,
       CAST(count_if(split = 'test') AS BIGINT) AS test,
       CAST(count(*) AS BIGINT) AS total
FROM split_ GROUP BY ROLLUP (label)""")

TEXT_LABEL = ("CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END")
SQL["class_balance"] = text_sql(f"""
SELECT CAST(count(*) AS BIGINT) AS classes, min(c) AS min_class, max(c) AS max_class,
       {rnd('CAST(max(c) AS DOUBLE) / CAST(min(c) AS DOUBLE)', 6)} AS imbalance_ratio
FROM (SELECT {TEXT_LABEL} AS label, CAST(count(*) AS BIGINT) AS c
      FROM posts_text WHERE sentiment IS NOT NULL GROUP BY 1) t WHERE label IS NOT NULL""")
SQL["quality_report"] = text_sql(f"""
SELECT rows, unmapped, classes, min_class, max_class,
       {rnd('CAST(max_class AS DOUBLE) / CAST(min_class AS DOUBLE)', 6)} AS imbalance_ratio,
       rows > 0 AS not_empty, unmapped = 0 AS all_mapped, classes > 1 AS multi_class,
       coalesce(min_class >= 15, false) AS min_class_ok,
       coalesce(CAST(max_class AS DOUBLE) / CAST(min_class AS DOUBLE) < 10, false) AS balanced
FROM (SELECT CAST(sum(c) AS BIGINT) AS rows,
             CAST(coalesce(sum(CASE WHEN label IS NULL THEN c END), 0) AS BIGINT) AS unmapped,
             CAST(count_if(label IS NOT NULL) AS BIGINT) AS classes,
             min(CASE WHEN label IS NOT NULL THEN c END) AS min_class,
             max(CASE WHEN label IS NOT NULL THEN c END) AS max_class
      FROM (SELECT {TEXT_LABEL} AS label, CAST(count(*) AS BIGINT) AS c
            FROM posts_text WHERE sentiment IS NOT NULL GROUP BY 1) t) s""")
_DIRTY_RAW = """CASE WHEN CAST(id AS BIGINT) % 8 % 4 = 0 THEN ' ' || strftime(date, '%Y-%m-%d')
                  WHEN CAST(id AS BIGINT) % 8 % 4 = 1 THEN strftime(date, '%d/%m/%Y')
                  WHEN CAST(id AS BIGINT) % 8 % 4 = 2 THEN strftime(date, '%Y-%m-%d')
                  WHEN CAST(id AS BIGINT) % 8 = 3 THEN 'n/a'
                  ELSE strftime(date, '%Y-%m-%d') || ' ' END"""
_CLEAN = """coalesce(CAST(try_strptime(trim(raw), '%Y-%m-%d') AS DATE),
                CAST(try_strptime(trim(raw), '%d/%m/%Y') AS DATE))"""
SQL["rejects_by_reason"] = with_views(f"""
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN date IS NULL THEN 'missing_date'
              WHEN sentiment IS NOT NULL AND sentiment NOT IN ('negative', 'neutral', 'positive') THEN 'unknown_sentiment'
              WHEN user_feedback IS NOT NULL AND user_feedback NOT IN ('0', '1', '2', '0.0', '1.0', '2.0') THEN 'bad_feedback'
              ELSE 'accepted' END AS reason
  FROM (SELECT date, sentiment, user_feedback FROM posts
        UNION ALL
        SELECT {_CLEAN} AS date, sentiment,
               CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'maybe'
                    WHEN CAST(id AS BIGINT) % 7 = 1 THEN '2.0' END AS user_feedback
        FROM (SELECT id, sentiment, {_DIRTY_RAW} AS raw FROM posts_text) h) u) t
GROUP BY reason""", views=("posts", "posts_text"))

# ---- review and updates ----------------------------------------------------------------

SQL["review_queue"] = with_views(f"""
SELECT q.id, t.text, q.sentiment, q.confidence, q.user_feedback
FROM (SELECT * FROM posts
      WHERE sentiment IS NOT NULL AND confidence IS NOT NULL AND user_feedback IS NULL
        AND confidence < {P.REVIEW_THRESHOLD}
      ORDER BY confidence ASC, id ASC LIMIT {P.REVIEW_LIMIT}) q
LEFT JOIN posts_text t ON q.id = t.id""", views=("posts", "posts_text"))
SQL["apply_scores"] = posts_sql("""
SELECT p.id, coalesce(u.sentiment, p.sentiment) AS sentiment, coalesce(u.confidence, p.confidence) AS confidence
FROM posts p LEFT JOIN (
  SELECT id,
         CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment,
         CAST(0.6 AS DOUBLE) + CAST(CAST(id AS BIGINT) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
  FROM posts WHERE sentiment IS NULL) u ON p.id = u.id""")
SQL["apply_feedback"] = posts_sql(f"""
SELECT p.id, coalesce(u.fb, p.user_feedback) AS user_feedback
FROM posts p LEFT JOIN (
  SELECT id,
         CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN CAST(CAST(id AS BIGINT) % 3 AS VARCHAR)
              ELSE CAST((CAST(id AS BIGINT) + 1) % 3 AS VARCHAR) END AS fb
  FROM posts
  WHERE sentiment IS NOT NULL AND user_feedback IS NULL AND confidence < {P.REVIEW_THRESHOLD}) u ON p.id = u.id""")

# ---- ingest ------------------------------------------------------------------------------

KW_CTE = "kw(keyword) AS (VALUES " + ", ".join(f"('{k}')" for k in P.KEYWORDS) + ")"
MATCH_CTE = """matched AS (
  SELECT k.keyword, p.id FROM posts_text p JOIN kw k ON instr(lower(p.text), k.keyword) > 0
  WHERE p.lang = 'en' AND NOT coalesce(regexp_matches(p.text, '^RT @'), false))"""
SQL["keyword_match"] = text_sql("SELECT keyword, id FROM matched", KW_CTE, MATCH_CTE)
LIST_CTE = r"""kw(keyword) AS (
  SELECT DISTINCT lower(trim(regexp_extract(text, '[^\x20\x09-\x0D]+'))) FROM documents
  WHERE length(regexp_extract(text, '[^\x20\x09-\x0D]+')) > 0)"""
SQL["keyword_match_list"] = text_sql("SELECT keyword, id FROM matched", LIST_CTE, MATCH_CTE)
SQL["high_water_marks"] = text_sql(
    "SELECT keyword, max(CAST(id AS BIGINT)) AS last_id FROM matched GROUP BY keyword", KW_CTE, MATCH_CTE)
SQL["incremental_since_id"] = """
SELECT e.event_id, e.event_type FROM events e
LEFT JOIN (SELECT event_type, max(event_id) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
           GROUP BY event_type) m ON e.event_type = m.event_type
WHERE m.m IS NULL OR e.event_id > m.m"""
SQL["append_new_only"] = posts_sql("SELECT id, date, sentiment FROM posts WHERE date >= DATE '2024-01-20'")

# ---- scalar functions and cleaning ---------------------------------------------------------

SQL["json_field"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
_am = "CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER)"
SQL["argmax_label"] = f"SELECT vec_id, label, {_am} AS pred, {name_sql(_am)} AS pred_name FROM embeddings"
SQL["clean_dates"] = text_sql("""
SELECT id, raw_date,
       coalesce(CAST(try_strptime(trim(raw_date), '%Y-%m-%d') AS DATE),
                CAST(try_strptime(trim(raw_date), '%d/%m/%Y') AS DATE)) AS date
FROM (SELECT id,
             CASE WHEN CAST(id AS BIGINT) % 8 % 4 = 0 THEN ' ' || strftime(date, '%Y-%m-%d')
                  WHEN CAST(id AS BIGINT) % 8 % 4 = 1 THEN strftime(date, '%d/%m/%Y')
                  WHEN CAST(id AS BIGINT) % 8 % 4 = 2 THEN strftime(date, '%Y-%m-%d')
                  WHEN CAST(id AS BIGINT) % 8 = 3 THEN 'n/a'
                  ELSE strftime(date, '%Y-%m-%d') || ' ' END AS raw_date
      FROM posts_text) t""")
SQL["clean_accounts"] = text_sql(r"""
SELECT regexp_replace(raw_account, '[\p{Z}\p{Cf}\t\r\n\f]', '', 'g') AS account, CAST(count(*) AS BIGINT) AS posts
FROM (SELECT CASE CAST(id AS BIGINT) % 4
                  WHEN 0 THEN ' @' || author_id
                  WHEN 1 THEN '@' || author_id || chr(8203)
                  WHEN 2 THEN '@' || author_id
                  ELSE '@' || author_id || ' ' || chr(9) END AS raw_account
      FROM posts_text) t GROUP BY 1""")
SQL["conform_posts"] = text_sql("""
SELECT id, [id] AS edit_history_tweet_ids, author_id, text, CAST(NULL AS VARCHAR) AS sentiment,
       CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS user_feedback, date
FROM posts_text""")


def key_sql(natural: str, h: int, salt: str) -> str:
    lo = 10 ** (h - 1)
    return (f"CAST({lo} + CAST(('0x' || substr(md5('{salt}' || {natural}), 1, 15)) AS BIGINT) % {9 * lo} AS BIGINT)")


SQL["surrogate_keys"] = text_sql(f"""
SELECT id, {key_sql('id', 12, 'post:')} AS post_key, {key_sql('author_id', 9, 'author:')} AS author_key,
       '[''' || CAST({key_sql('id', 12, 'post:')} AS VARCHAR) || ''']' AS edit_history_text
FROM posts_text""")

TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_tid = "CAST((CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 262144) + 1 AS INTEGER)"
SQL["tokenize_fixed"] = text_sql(f"""
SELECT id,
       list_resize(list_transform(list_slice(tok, 1, {P.MAX_LENGTH}), lambda t: {_tid}), {P.MAX_LENGTH}, 0) AS input_ids,
       list_transform(range(1, {P.MAX_LENGTH + 1}),
                      lambda i: CASE WHEN i <= least(len(tok), {P.MAX_LENGTH}) THEN 1 ELSE 0 END) AS attention_mask,
       CAST(len(tok) AS INTEGER) AS n_tokens
FROM (SELECT id, {TOKENS} AS tok FROM posts_text) t""")


def _lex(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def lexicon_counts_sql() -> str:
    from ..functions.text import NEGATIVE_WORDS, POSITIVE_WORDS
    return f"""(SELECT id,
             CAST(len(list_filter(tok, lambda x: list_contains({_lex(POSITIVE_WORDS)}, x))) AS BIGINT) AS n_pos,
             CAST(len(list_filter(tok, lambda x: list_contains({_lex(NEGATIVE_WORDS)}, x))) AS BIGINT) AS n_neg
      FROM (SELECT id, {TOKENS} AS tok FROM posts_text WHERE {{where}}) t) c"""


SQL["score_posts_lexicon"] = text_sql(f"""
SELECT id, n_pos, n_neg,
       CASE WHEN n_pos > n_neg THEN 'positive' WHEN n_neg > n_pos THEN 'negative' ELSE 'neutral' END AS sentiment,
       {rnd('(1.0 + abs(n_pos - n_neg)) / (2.0 + n_pos + n_neg)', 6)} AS confidence
FROM {lexicon_counts_sql().format(where='TRUE')}""")
_z = "[n_neg::DOUBLE, 0.5::DOUBLE, n_pos::DOUBLE]"
SQL["score_posts"] = text_sql(f"""
SELECT id, ['negative', 'neutral', 'positive'][k] AS sentiment, {rnd('e[k] / (e[1] + e[2] + e[3])', 6)} AS confidence
FROM (SELECT id, e, list_position(e, list_max(e)) AS k
      FROM (SELECT id, list_transform({_z}, lambda x: exp(x - list_max({_z}))) AS e
            FROM {lexicon_counts_sql().format(where='sentiment IS NULL')}) a) b""")


# ---- sources and sinks ---------------------------------------------------------------------------

SQL["ingest_search_pages"] = text_sql("""
SELECT id, [id] AS edit_history_tweet_ids, author_id, text, CAST(NULL AS VARCHAR) AS sentiment,
       CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS user_feedback, date
FROM posts_text WHERE lang = 'en'""")
_raw = ("CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN strftime(date, '%d/%m/%Y') "
        "ELSE strftime(date, '%Y-%m-%d') END")
SQL["ingest_history_csv"] = text_sql(f"""
SELECT CAST(pk AS VARCHAR) AS id, [CAST(pk AS VARCHAR)] AS edit_history_tweet_ids,
       CAST(ak AS VARCHAR) AS author_id, text, CAST(NULL AS VARCHAR) AS sentiment,
       CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS user_feedback, date
FROM (SELECT {key_sql("acc || '|' || raw || '|' || text", 12, 'post:')} AS pk,
             {key_sql('acc', 9, 'author:')} AS ak, text, date
      FROM (SELECT '@' || author_id AS acc, {_raw} AS raw, text, date FROM posts_text) a) b""")
SQL["training_log_rows"] = runs_sql("""
SELECT date_trunc('second', start_time) AS run_time, 'eval' AS kind, epoch, CAST(1 AS BIGINT) AS step,
       eval_loss, eval_accuracy, CAST(NULL AS DOUBLE) AS train_runtime
FROM training_runs
UNION ALL
SELECT date_trunc('second', start_time), 'summary', epoch, CAST(1 AS BIGINT), NULL, NULL,
       CAST(epoch(date_trunc('second', end_time)) - epoch(date_trunc('second', start_time)) AS DOUBLE)
FROM training_runs""")
SQL["append_posts"] = posts_sql("""
SELECT id, author_id, date,
       CASE WHEN date < DATE '2024-01-16' THEN sentiment END AS sentiment,
       CASE WHEN date < DATE '2024-01-16' THEN confidence END AS confidence,
       CASE WHEN date < DATE '2024-01-16' THEN user_feedback END AS user_feedback
FROM posts""")
SQL["publish_reputation"] = SQL["daily_reputation"]
SQL["append_training_run"] = runs_sql(f"""
SELECT strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time,
       strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time,
       eval_loss, eval_accuracy, eval_runtime, eval_samples_per_second,
       CAST({rnd('eval_runtime * eval_samples_per_second', 0)} AS BIGINT) AS eval_rows
FROM training_runs""")

# ---- a classifier in closed form -----------------------------------------------------------------

_NB = (f"labels_ AS (SELECT id, {TEXT_LABEL} AS label FROM posts_text WHERE sentiment IS NOT NULL)", SPLIT_CTE,
       f"tok AS (SELECT s.id, s.label, s.split, {TOKENS} AS w FROM split_ s JOIN posts_text p ON s.id = p.id)", """
seen AS (SELECT t AS token, label, count(*) AS c FROM (SELECT label, unnest(w) AS t FROM tok WHERE split = 'train') x GROUP BY ALL),
cls AS (
  SELECT r.label AS pred, ln(r.n) AS prior,
         ln(coalesce((SELECT sum(c) FROM seen WHERE seen.label = r.label), 0) + (SELECT count(DISTINCT token) FROM seen)) AS total
  FROM (SELECT label, count(*) AS n FROM tok WHERE split = 'train' GROUP BY label) r),
ev AS (
  SELECT t.id, s.label AS pred, sum(t.n * ln(s.c + 1)) AS e
  FROM (SELECT id, t AS token, count(*) AS n FROM (SELECT id, unnest(w) AS t FROM tok WHERE split = 'test') x GROUP BY ALL) t
  JOIN seen s ON t.token = s.token GROUP BY ALL),
sc AS (
  SELECT k.id, k.label, c.pred, c.prior + coalesce(ev.e, 0) - len(k.w) * c.total AS s
  FROM (SELECT * FROM tok WHERE split = 'test') k CROSS JOIN cls c LEFT JOIN ev ON ev.id = k.id AND ev.pred = c.pred),
predictions AS (
  SELECT id, label, pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, pred) AS r FROM sc) x WHERE r = 1)""")
SQL["naive_bayes_predictions"] = text_sql("SELECT id, label, CAST(pred AS INTEGER) AS pred FROM predictions", *_NB)
SQL["naive_bayes_macro_f1"] = text_sql(f"""
SELECT {rnd('avg(2.0 * tp / (support + predicted))', 6)} AS macro_f1, CAST(count(*) AS BIGINT) AS classes
FROM (SELECT cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
      FROM (SELECT label AS cls, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 1 AS support, 0 AS predicted FROM predictions
            UNION ALL SELECT pred, 0, 0, 1 FROM predictions) x GROUP BY cls) y""", *_NB)

_ALPHAS = "alpha(k, a) AS (VALUES " + ", ".join(f"({k}, CAST({a!r} AS DOUBLE))" for k, a in enumerate(SETTINGS)) + ")"
_TRAIN = _NB[:3] + (_NB[3].split("cls AS (")[0].rstrip().rstrip(","), _ALPHAS, f"""
rows_ AS (SELECT label AS pred, count(*) AS n FROM tok WHERE split = 'train' GROUP BY label),
known AS (SELECT (SELECT count(DISTINCT token) FROM seen) AS v),
cls AS (SELECT r.pred, ln(r.n) AS prior, CAST(coalesce((SELECT sum(c) FROM seen WHERE seen.label = r.pred), 0) AS DOUBLE) AS tokens FROM rows_ r),
ev AS (
  SELECT t.id, k, s.label AS pred, sum(t.n * (ln(s.c + a) - ln(a))) AS e
  FROM (SELECT id, t AS token, count(*) AS n FROM (SELECT id, unnest(w) AS t FROM tok WHERE split <> 'train') x GROUP BY ALL) t
  JOIN seen s ON t.token = s.token CROSS JOIN alpha GROUP BY ALL),
sc AS (
  SELECT x.id, x.label, x.split, alpha.k, c.pred, c.prior + coalesce(ev.e, 0) + len(x.w) * (ln(a) - ln(c.tokens + a * v)) AS s
  FROM (SELECT * FROM tok WHERE split <> 'train') x CROSS JOIN cls c CROSS JOIN alpha CROSS JOIN known
  LEFT JOIN ev ON ev.id = x.id AND ev.pred = c.pred AND ev.k = alpha.k),
top AS (SELECT *, max(s) OVER (PARTITION BY id, k) AS m, row_number() OVER (PARTITION BY id, k ORDER BY s DESC, pred) AS r FROM sc),
pr AS (
  SELECT id, label, split, k, max(CASE WHEN r = 1 THEN pred END) AS pred,
         coalesce(sum(CASE WHEN pred = label THEN exp(s - m) END), 0) / sum(exp(s - m)) AS p_true
  FROM top GROUP BY ALL),
f1 AS (
  SELECT split, k, {rnd('avg(f)', 6)} AS f1
  FROM (SELECT split, k, cls, 2.0 * sum(tp) / sum(n) AS f
        FROM (SELECT split, k, label AS cls, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 1 AS n FROM pr
              UNION ALL SELECT split, k, pred, 0, 1 FROM pr) x GROUP BY ALL) y GROUP BY ALL),
mt AS (
  SELECT split, k, {rnd('sum(-ln(greatest(least(p_true, 1 - 1e-15), 1e-15))) / count(*)', 6)} AS loss,
         {rnd('sum(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) / count(*)', 6)} AS acc, count(*) AS n
  FROM pr GROUP BY ALL),
best AS (SELECT k FROM f1 WHERE split = 'validation' ORDER BY f1 DESC, k LIMIT 1),
res AS (
  SELECT loss AS eval_loss, acc AS eval_accuracy, f.f1 AS eval_f1, CAST(n AS BIGINT) AS test_rows, a AS smoothing, w.f1 AS val_f1
  FROM best JOIN mt ON mt.k = best.k AND mt.split = 'test' JOIN f1 f ON f.k = best.k AND f.split = 'test'
  JOIN f1 w ON w.k = best.k AND w.split = 'validation' JOIN alpha ON alpha.k = best.k)""",)
SQL["train_evaluate"] = text_sql("SELECT * FROM res", *_TRAIN)
SQL["train_gate"] = text_sql("""
SELECT g AS threshold, eval_loss, eval_accuracy, eval_f1, test_rows, smoothing, eval_accuracy >= g AS passed,
       CASE WHEN eval_accuracy >= g THEN (SELECT count(*) FROM seen) ELSE 0 END AS model_rows,
       CASE WHEN eval_accuracy >= g THEN eval_accuracy END AS reloaded_accuracy
FROM res CROSS JOIN (VALUES """ + ", ".join(f"(CAST({g} AS DOUBLE))" for g in P.GATES) + ") gates(g)", *_TRAIN)
SQL["split_corpus"] = text_sql("SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM split_ GROUP BY split, label", *_NB[:2])

# ---- the jobs over a warehouse ------------------------------------------------------------------

SQL["crawl_posts"] = text_sql("SELECT DISTINCT p.id, p.date, p.author_id FROM matched m JOIN posts_text p ON p.id = m.id", KW_CTE, MATCH_CTE)
SQL["crawl_marks"] = SQL["high_water_marks"]
SQL["feedback_files"] = SQL["apply_feedback"]

# ---- streaming ---------------------------------------------------------------------------------------

SQL["stream_ingest"] = posts_sql("SELECT id, date, sentiment FROM posts")
SQL["stream_dedup"] = SQL["stream_ingest"]
SQL["stream_daily_counts"] = SQL["counts_by_day_class"]
SQL["stream_daily_reputation"] = SQL["daily_reputation"]
SQL["stream_upsert"] = f"""
SELECT s.id, s.sentiment, s.confidence, f.user_feedback
FROM ({SQL["apply_scores"]}) s JOIN ({SQL["apply_feedback"]}) f ON s.id = f.id"""
SQL["stream_score"] = SQL["score_posts"]
SQL["stream_closed_days"] = daily_sql(
    "SELECT * FROM daily WHERE CAST(date AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)")
