"""Shared SQL of the checks: the complaint mapping and small helpers, for DuckDB."""

from __future__ import annotations

from caselens.functions import rules
from caselens.sources import standin


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def case_map(key: str, mapping: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {default} END"


def nth(values: list[str | None], index: str) -> str:
    return f"(list_value({', '.join(q(v) for v in values)}))[CAST({index} AS INT) + 1]"


def up(x: str, digits: int) -> str:
    return f"(round(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0::DOUBLE)"


def even(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0::DOUBLE)"


def pct(part: str, whole: str, digits: int) -> str:
    return up(f"100.0::DOUBLE * ({part}) / nullif(({whole})::DOUBLE, 0)", digits)


def pct_if(cond: str, digits: int) -> str:
    return pct(f"count(*) FILTER ({cond})", "count(*)", digits)


QUARTER = "year(date_received)::VARCHAR || '-Q' || quarter(date_received)::VARCHAR"
ISSUER_LIST = ", ".join(q(i) for i in standin.ISSUERS.values())
FOCUS = q(standin.FOCUS)

CARDS = f"""
docs_n AS (SELECT count(*) AS n FROM documents),
first_part AS (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey),
mapped AS (
  SELECT o.o_orderkey AS complaint_id, o.o_orderdate::DATE AS date_received,
    (o.o_orderdate::DATE + (o.o_orderkey % 5)::INT)::DATE AS date_sent_to_company,
    CASE WHEN o.o_orderdate::DATE < DATE '{standin.RENAMED_FROM}' THEN {q(rules.CARD_PRODUCT_BEFORE_RENAME)}
         ELSE {q(rules.CARD_PRODUCT)} END AS product,
    CASE o.o_orderkey % 10 WHEN 0 THEN 'Store credit card' WHEN 1 THEN 'General-purpose prepaid card'
         WHEN 2 THEN NULL ELSE 'General-purpose credit card or charge card' END AS sub_product,
    o.o_orderpriority AS issue,
    {case_map('p.p_type', standin.SUB_ISSUE_BY_TYPE)} AS sub_issue,
    nullif(trim(d.text || ' ' || {nth(standin.PHRASES, 'o.o_orderkey % 7')}), '') AS narrative,
    p.p_brand AS company_public_response, trim(n.n_name) AS company, c.c_mktsegment AS state,
    o.o_custkey::VARCHAR AS zip_code,
    CASE WHEN o.o_custkey % 4 = 0 THEN 'Older American' END AS tags, p.p_type AS submitted_via,
    CASE o.o_orderstatus WHEN 'O' THEN {q(rules.EXPLANATION)} WHEN 'F' THEN {q(rules.MONETARY_RELIEF)}
      ELSE {nth([rules.IN_PROGRESS, rules.NON_MONETARY_RELIEF, rules.UNTIMELY], 'o.o_custkey % 3')}
      END AS company_response,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 50 = 0 THEN 'No' ELSE 'Yes' END
      AS timely_response,
    'Export_' || (o.o_orderkey % 8 + 4) || '_part.csv' AS source_file
  FROM orders o CROSS JOIN docs_n
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN first_part f ON f.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = f.pk
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey % docs_n.n AND (o.o_orderkey // docs_n.n) % 2 = 0
),
cards AS (
  SELECT *, date_trunc('month', date_received)::DATE AS month, year(date_received) AS year,
    {QUARTER} AS quarter
  FROM mapped
  WHERE date_received >= DATE '{standin.START}'
    AND (product = {q(rules.CARD_PRODUCT)}
         OR sub_product IN ({', '.join(q(s) for s in rules.CARD_SUB_PRODUCTS_BEFORE_RENAME)}))
),
complaints AS (
  SELECT *, narrative IS NOT NULL AS has_narrative,
    {case_map('sub_issue', rules.VALUE_ISSUES)} AS value_issue
  FROM (SELECT {case_map('company', standin.ISSUERS)} AS issuer, * FROM cards)
  WHERE issuer IS NOT NULL
)"""

_CAPS = case_map("issuer", {k: str(v) for k, v in standin.CAPS.items()}, "NULL")

ELIGIBLE = f"""
eligible AS (
  SELECT complaint_id, issuer, date_received, quarter, issue, sub_issue, company_response, narrative, zip_code
  FROM complaints
  WHERE length(narrative) >= {rules.SAMPLE_MIN_CHARS} AND date_received <= DATE '{standin.CUTOFF}'
)"""

SAMPLE = f"""{ELIGIBLE},
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY issuer, quarter) AS stratum_size,
    row_number() OVER (PARTITION BY issuer, quarter
      ORDER BY md5('{rules.SAMPLE_SEED}:' || complaint_id::VARCHAR), complaint_id) AS pos,
    coalesce(({_CAPS})::INT, {standin.DEFAULT_CAP}) AS cap
  FROM eligible
),
sample AS (
  SELECT * EXCLUDE (pos, cap), stratum_size / least(stratum_size, cap)::DOUBLE AS weight
  FROM ranked WHERE pos <= cap
)"""


def nth_list(values: list[list[str]], index: str) -> str:
    whens = " ".join(
        f"WHEN {i} THEN CAST([{', '.join(q(v) for v in vs)}] AS VARCHAR[])" for i, vs in enumerate(values)
    )
    return f"CASE {index} {whens} END"


ORDER_LABELS = f"""
order_labels AS (
  SELECT complaint_id,
    {nth(rules.THEMES, 'zip_code::BIGINT % 10')} AS primary_theme,
    CASE WHEN complaint_id % 3 = 0 THEN {nth(rules.THEMES, '(zip_code::BIGINT + 3) % 10')} END AS secondary_theme,
    {nth(rules.SENTIMENTS, 'zip_code::BIGINT % 3')} AS sentiment,
    {nth_list(standin.NAMED_BENEFITS, 'complaint_id % 4')} AS named_benefits,
    {nth(standin.CARD_PRODUCTS, 'complaint_id % 5')} AS card_product
  FROM complaints WHERE complaint_id % 11 <> 0
)"""

LABELLED = f"""{SAMPLE},{ORDER_LABELS},
labelled AS (
  SELECT s.* EXCLUDE (weight), l.* EXCLUDE (complaint_id),
    s.stratum_size / count(*) OVER (PARTITION BY s.issuer, s.quarter) AS weight,
    FALSE AS narrative_truncated, 'llm' AS label_source
  FROM sample s JOIN order_labels l USING (complaint_id)
)"""

LEDGER = f"""
n_items AS (SELECT floor(count(*) * 0.6::DOUBLE)::BIGINT AS n FROM events),
ledger AS (
  SELECT event_id AS seq, event_id % n_items.n AS complaint_id,
    CASE user_id % 2 WHEN 0 THEN 'model_0' ELSE 'model_1' END AS model,
    CASE event_id % 9 WHEN 0 THEN 'v0' ELSE 'v1' END AS prompt_version,
    CASE user_id % 2 WHEN 0 THEN 'batch' ELSE 'sync' END AS mode,
    'pack-' || (event_id // 8)::VARCHAR AS pack_id,
    CASE event_type WHEN 'click' THEN 'parse_error' WHEN 'error' THEN 'api_error'
      WHEN 'signup' THEN 'missing_in_response' ELSE 'ok' END AS status,
    floor(value * 10) AS input_tokens, floor(value * 10) + 5 AS output_tokens,
    CASE user_id % 3 WHEN 0 THEN floor(value * 10) * 2 ELSE 0 END AS cache_read_tokens,
    CASE user_id % 5 WHEN 0 THEN floor(value * 10) ELSE 0 END AS cache_write_tokens,
    value > 200 AS narrative_truncated,
    {nth(rules.THEMES, 'user_id % 10')} AS primary_theme,
    NULL::VARCHAR AS secondary_theme,
    {nth(rules.SENTIMENTS, 'user_id % 3')} AS sentiment,
    {nth_list(standin.NAMED_BENEFITS, 'event_id % 4')} AS named_benefits,
    {nth(standin.CARD_PRODUCTS, 'event_id % 5')} AS card_product
  FROM events CROSS JOIN n_items
)"""

MODEL_LABELS = f"""{ELIGIBLE},
model_labels AS (
  SELECT complaint_id, issuer, date_received, {nth(rules.THEMES, 'zip_code::BIGINT % 10')} AS primary_theme
  FROM eligible
)"""


def over(*parts: str, body: str) -> str:
    """WITH the given named parts, then the body (which may add its own after a comma)."""
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + body
