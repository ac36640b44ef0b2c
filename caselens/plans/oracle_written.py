"""SQL checks of what is written and read back, and of the label-run totals."""

from __future__ import annotations

from caselens.functions import rules
from caselens.plans import oracle_labels
from caselens.plans.oracle_base import CARDS, LABELLED, LEDGER, ISSUER_LIST, even, over
from caselens.plans.oracle_benchmark import VOLUME_CTE, trend_cte
from caselens.sources import standin

SQL: dict[str, str] = {}
SQL["ledger_round_trip"] = f"""
SELECT complaint_id, model, primary_theme, secondary_theme, CASE WHEN complaint_id % 2 = 0 THEN 'neutral_or_mixed' ELSE sentiment END AS sentiment,
  named_benefits, card_product, narrative_truncated
FROM ({oracle_labels.SQL["label_pack_parse"]}) WHERE status = 'ok'"""
SQL["ordered_result"] = over(
    CARDS, trend_cte(), body="SELECT issuer, month, complaints, row_number() OVER (ORDER BY issuer, month) AS position FROM trend"
)
SQL["stored_views"] = over(
    CARDS, VOLUME_CTE,
    body=""", by_entity AS (SELECT entity AS issuer, year, sum(value) AS purchase_volume FROM scoped GROUP BY ALL)
SELECT c.issuer, c.year, c.complaints, a.cards, v.purchase_volume
FROM (SELECT issuer, year, count(*) AS complaints FROM complaints GROUP BY ALL) c
JOIN (SELECT year, count(*) AS cards FROM cards GROUP BY ALL) a USING (year)
LEFT JOIN by_entity v ON v.issuer = c.issuer AND v.year = c.year""",
)
_PER_ROW = f"{oracle_labels._COST} * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / n"
SQL["cost_full_sample"] = over(
    CARDS, LABELLED, LEDGER, oracle_labels.PRICES,
    body=f"""SELECT model, CASE WHEN n >= {rules.MIN_ROWS_FOR_MEASURED_COST} THEN {even(_PER_ROW, 5)} END AS measured_cost_per_row_usd,
  CASE WHEN n >= {rules.MIN_ROWS_FOR_MEASURED_COST} THEN {even(f"{_PER_ROW} * (SELECT count(*) FROM sample)", 2)} END AS full_sample_cost_usd
FROM (SELECT model, count(*) AS n, {oracle_labels._SUMS} FROM ledger WHERE prompt_version = 'v1' AND status <> 'api_error' GROUP BY ALL)
JOIN prices USING (model)""",
)
_SPENT = f"sum({oracle_labels._COST} * CASE mode WHEN 'batch' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"
SQL["facts_label_totals"] = over(
    CARDS, LABELLED, LEDGER, oracle_labels.PRICES,
    body=f""", facts AS (
  SELECT 'sample_rows' AS key, count(*)::DOUBLE AS value FROM sample
  UNION ALL SELECT 'rows_labelled', count(*)::DOUBLE FROM labelled
  UNION ALL SELECT 'budget_usd', {rules.BUDGET_USD}::DOUBLE
  UNION ALL SELECT 'spend_usd', {even(_SPENT, 4)} FROM (SELECT model, mode, {oracle_labels._SUMS} FROM ledger GROUP BY ALL) JOIN prices USING (model))
SELECT 'label_run' AS section, key, NULL::VARCHAR AS subkey, value, NULL::VARCHAR AS text FROM facts""",
)
SQL["chart_issue_matrix"] = f"""
WITH heat AS ({oracle_labels.SQL["chart_issue_heat"]}),
kept AS (SELECT issue, any_value(all_complaints) AS n FROM heat GROUP BY issue ORDER BY n DESC, issue LIMIT {standin.HEAT_TOP})
SELECT list_position([{ISSUER_LIST}], issuer)::INT AS row, issuer, string_agg(issue, ';' ORDER BY n DESC, issue) AS issues,
  string_agg(share_pct::VARCHAR, ';' ORDER BY n DESC, issue) AS shares
FROM heat JOIN kept USING (issue) GROUP BY issuer"""
