"""SQL checks of the text model: vocabulary, scores of given coefficients, folds, their scores, reports."""

from __future__ import annotations

from caselens.functions import rules
from caselens.operators.textmodel import MIN_DF
from caselens.plans.oracle_base import CARDS, MODEL_LABELS, even, over, q
from caselens.plans.oracle_benchmark import TOLD
from caselens.sources import standin

SQL: dict[str, str] = {}
LABEL = f"CASE WHEN doc_id < {standin.RARE_ROWS} THEN {q(standin.RARE_LABEL)} ELSE lang END"
STOP = ", ".join(q(w) for w in standin.GIVEN_STOP_WORDS)

TERMS = f"""
doc_words AS (
  SELECT doc_id, {LABEL} AS label, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))),
      '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({STOP})) AS w
  FROM documents
),
doc_terms AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM doc_words)
  GROUP BY ALL
),
vocabulary AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, row_number() OVER (ORDER BY sum(tf) DESC, term) - 1 AS index
  FROM doc_terms GROUP BY term HAVING count(*) >= {MIN_DF}
)"""
_CLASSES = list(enumerate(standin.GIVEN_CLASSES))
_SUMS = ", ".join(f"sum(x * (((index * {2 * k + 3} + {k}) % 11 - 5) / 2.0::DOUBLE)) AS s{k}" for k, _ in _CLASSES)
_LOGITS = ", ".join(f"coalesce(s{k} / length, 0) + {(k - 1.5) / 4}::DOUBLE" for k, _ in _CLASSES)
SCORED = f"""
weighted AS (
  SELECT doc_id, index, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS x
  FROM doc_terms JOIN vocabulary USING (term) WHERE index < {standin.GIVEN_TERMS}
),
sums AS (SELECT doc_id, sqrt(sum(x * x)) AS length, {_SUMS} FROM weighted GROUP BY doc_id),
logits AS (SELECT doc_id, label, [{_LOGITS}] AS z FROM doc_words LEFT JOIN sums USING (doc_id)),
scored AS (
  SELECT doc_id, label, (list_value({', '.join(q(c) for c in standin.GIVEN_CLASSES)}))[list_position(z, list_max(z))] AS primary_theme,
    1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) AS confidence
  FROM logits
)"""
FOLDS = f"""
predicted AS (SELECT doc_id, label, CASE WHEN label <> {q(standin.RARE_LABEL)} THEN primary_theme END AS primary_theme FROM scored),
sides AS (
  SELECT label AS theme, true AS truth, label = primary_theme AS same, primary_theme IS NOT NULL AS tested FROM predicted
  UNION ALL SELECT primary_theme, false, label = primary_theme, true FROM predicted WHERE primary_theme IS NOT NULL
),
per_theme AS (
  SELECT theme, CASE WHEN bool_or(tested) THEN count(*) FILTER (same) / count(*)::DOUBLE END AS f1,
    count(*) FILTER (same AND truth) AS hits, count(*) FILTER (truth) AS rows, count(*) FILTER (truth AND tested) AS tested_rows
  FROM sides GROUP BY theme
),
fold_scores AS (
  SELECT 'agreement' AS metric, NULL::VARCHAR AS theme, {even('sum(hits) / sum(tested_rows)::DOUBLE', 3)} AS value, sum(tested_rows)::BIGINT AS rows FROM per_theme
  UNION ALL SELECT 'macro_f1', NULL, {even('avg(f1)', 3)}, sum(tested_rows)::BIGINT FROM per_theme
  UNION ALL SELECT 'f1', theme, {even('f1', 3)}, rows FROM per_theme
)"""

SQL["model_vocabulary"] = over(TERMS, body="SELECT term, df, total, index FROM vocabulary")
SQL["model_scores"] = over(TERMS, SCORED, body=f"SELECT doc_id, primary_theme, {even('confidence', 6)} AS confidence FROM scored")
_SHARE = even("100.0::DOUBLE * count(*) / (SELECT count(*) FROM scored)::DOUBLE", 1)
SQL["model_scores_share"] = over(TERMS, SCORED, body=f"SELECT primary_theme, {_SHARE} AS share_pct FROM scored GROUP BY 1")
SQL["model_folds"] = f"""
SELECT doc_id AS row_id, label, CASE WHEN count(*) OVER (PARTITION BY label) >= 5
  THEN ((row_number() OVER (PARTITION BY label ORDER BY md5('{rules.MODEL_SEED}:' || doc_id::VARCHAR), doc_id) - 1) % 5)::INT END AS fold
FROM (SELECT doc_id, {LABEL} AS label FROM documents) WHERE label IS NOT NULL"""
SQL["model_f1"] = over(TERMS, SCORED, FOLDS, body="SELECT * FROM fold_scores")
SQL["model_report"] = over(
    TERMS, SCORED, FOLDS,
    body=f"""SELECT 'narratives_labelled' AS key, NULL::VARCHAR AS theme, count(*)::DOUBLE AS value FROM scored
UNION ALL SELECT 'theme_share_pct', primary_theme, {_SHARE} FROM scored GROUP BY 2
UNION ALL SELECT 'training_rows', NULL, count(*)::DOUBLE FROM predicted
UNION ALL SELECT 'cv_' || metric, theme, value FROM fold_scores""",
)
SQL["model_report_keywords"] = over(
    CARDS, MODEL_LABELS, TOLD,
    body=f""", singles AS (SELECT complaint_id, themes[1] AS theme,
    row_number() OVER (PARTITION BY themes[1] ORDER BY md5('{rules.MODEL_SEED}:' || complaint_id::VARCHAR), complaint_id) AS pos
  FROM told WHERE len(themes) = 1),
seeds AS (SELECT * FROM singles WHERE pos <= {standin.SEED_CAP})
SELECT 'narratives_labelled' AS key, NULL::VARCHAR AS theme, count(*)::DOUBLE AS value FROM model_labels
UNION ALL SELECT 'theme_share_pct', primary_theme, {even("100.0::DOUBLE * count(*) / (SELECT count(*) FROM model_labels)::DOUBLE", 1)} FROM model_labels GROUP BY 2
UNION ALL SELECT 'narratives_matching_no_rule', NULL, count(*)::DOUBLE FROM told WHERE len(themes) = 0
UNION ALL SELECT 'training_rows', NULL, count(*)::DOUBLE FROM seeds
UNION ALL SELECT 'seed_rows_by_theme', theme, count(*)::DOUBLE FROM seeds GROUP BY 2""",
)
