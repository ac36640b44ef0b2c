"""SQL checks of the benchmark, profile, ingest and sampling queries."""

from __future__ import annotations

from caselens.functions import rules
from caselens.plans.oracle_base import (
    CARDS,
    ELIGIBLE,
    FOCUS,
    ISSUER_LIST,
    QUARTER,
    SAMPLE,
    case_map,
    over,
    pct,
    pct_if,
    q,
    up,
)
from caselens.sources import standin

# --- keyword patterns in RE2 -------------------------------------------------------------
WORD = r"[^\p{L}\p{N}_]"


def hit(pattern: str, text: str = "narrative") -> str:
    return f"regexp_matches({text}, {q('(?i)' + pattern)})"


def text_hit(pattern: str, text: str = "narrative") -> str:
    r"""Text-dialect rule: \b next to any letter or digit, written out since RE2 knows ASCII only."""
    spelled = {
        r"\b(points|miles)\b": rf"(^|{WORD})(points|miles)({WORD}|$)",
        r"rewards?\b": rf"rewards?({WORD}|$)",
        r"\blounges?\b": rf"(^|{WORD})lounges?({WORD}|$)",
        r"\bapr\b": rf"(^|{WORD})apr({WORD}|$)",
    }
    for short, long in spelled.items():
        pattern = pattern.replace(short, long)
    return hit(pattern, text)


def mix(category: str, keep: str) -> str:
    """Own and peer shares from totals per category and issuer; every pair is looked at."""
    cats = [c.strip() for c in category.split(",")]
    same = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in cats)
    listed = ", ".join(f"y.{c}" for c in cats)
    return over(
        CARDS,
        body=f""", src AS (SELECT issuer, issue, coalesce(sub_issue, '(none)') AS sub_issue FROM complaints),
per_cat AS (SELECT {category}, count(*) AS cat_n FROM src GROUP BY ALL),
per_issuer AS (SELECT issuer, count(*) AS own_total FROM src GROUP BY ALL),
per_cell AS (SELECT issuer, {category}, count(*) AS n FROM src GROUP BY ALL),
everyone AS (SELECT count(*) AS all_n FROM src),
cells AS (
  SELECT i.issuer, {listed}, coalesce(x.n, 0) AS n, y.cat_n - coalesce(x.n, 0) AS p,
    i.own_total AS t, e.all_n - i.own_total AS pt
  FROM per_cat y CROSS JOIN per_issuer i CROSS JOIN everyone e
  LEFT JOIN per_cell x ON x.issuer = i.issuer AND {same})
SELECT issuer, {category}, n AS complaints, {pct('n', 't', 2)} AS share_pct, {pct('p', 'pt', 2)} AS peers_share_pct,
  {up('100.0::DOUBLE * n / nullif(t::DOUBLE, 0) - 100.0::DOUBLE * p / nullif(pt::DOUBLE, 0)', 2)} AS diff_vs_peers_pts,
  {up('(n / nullif(t::DOUBLE, 0)) / nullif(p / nullif(pt::DOUBLE, 0), 0)', 2)} AS index_vs_peers
FROM cells {keep}""",
    )


def trend_cte() -> str:
    return f"""per_month AS (SELECT issuer, month, count(*) AS complaints FROM complaints GROUP BY ALL),
trend AS (
  SELECT issuer, month, complaints,
    {pct('complaints', '(SELECT count(*) FROM cards k WHERE k.month = m.month)', 2)} AS share_of_all_pct,
    {pct('complaints', f'(SELECT avg(b.complaints) FROM per_month b WHERE b.issuer = m.issuer AND year(b.month) = {standin.BASE_YEAR})', 1)}
      AS index_vs_base_avg,
    {up('avg(complaints) OVER (PARTITION BY issuer ORDER BY month ROWS 2 PRECEDING)', 1)} AS complaints_3m_avg
  FROM per_month m
  WHERE EXISTS (SELECT 1 FROM per_month b WHERE b.issuer = m.issuer AND year(b.month) = {standin.BASE_YEAR}))"""


VALUE_PANEL = f"""
  SELECT issuer, month, count(*) AS complaints, count(value_issue) AS value_complaints,
    count(*) FILTER (value_issue = 'Fees') AS fees, count(*) FILTER (value_issue = 'Rewards') AS rewards,
    count(*) FILTER (value_issue = 'Promotional terms not received') AS promo_terms,
    count(*) FILTER (value_issue = 'Confusing advertising') AS confusing_advertising,
    {pct('count(value_issue)', 'count(*)', 2)} AS value_share_pct
  FROM complaints GROUP BY ALL"""

_M = {k: hit(p) for k, p in rules.MENTION_PATTERNS.items()}
MENTIONS = f"""
  SELECT issuer, month, count(*) AS narratives,
    {', '.join(f'count(*) FILTER ({cond}) AS mentions_{k}' for k, cond in _M.items())},
    count(*) FILTER ({_M['platinum']} AND {_M['annual_fee']}) AS mentions_platinum_and_annual_fee,
    count(*) FILTER ({_M['sapphire_reserve']} AND {_M['annual_fee']}) AS mentions_sapphire_reserve_and_annual_fee
  FROM complaints WHERE narrative IS NOT NULL AND month <= DATE '{standin.CUTOFF_MONTH}' GROUP BY ALL"""

OUTCOMES = f"""
  SELECT issuer, count(*) AS closed_complaints,
    {pct_if(f"company_response = {q(rules.MONETARY_RELIEF)}", 1)} AS monetary_relief_pct,
    {pct_if(f"company_response = {q(rules.NON_MONETARY_RELIEF)}", 1)} AS non_monetary_relief_pct,
    {pct_if(f"company_response = {q(rules.EXPLANATION)}", 1)} AS explanation_only_pct,
    {pct_if(f"company_response = {q(rules.UNTIMELY)}", 2)} AS untimely_pct
  FROM complaints WHERE company_response <> {q(rules.IN_PROGRESS)} GROUP BY issuer"""

TIMELY = f"""
  SELECT issuer, year, count(*) AS complaints, count(*) FILTER (timely_response = 'No') AS not_timely,
    {pct_if("timely_response = 'Yes'", 2)} AS timely_pct
  FROM complaints WHERE timely_response IS NOT NULL GROUP BY issuer, year"""

VOLUME_CTE = f"""
scoped AS (
  SELECT CASE n.n_name WHEN 'NATION_1' THEN 'Issuer B Holdings' ELSE
      coalesce({case_map('n.n_name', standin.ISSUERS)}, n.n_name) END AS entity,
    year(o_orderdate) AS year, CASE c.c_mktsegment WHEN 'BUILDING' THEN 'retail' ELSE 'branded' END AS scope,
    round(sum(o_totalprice) / 1e6, 1) AS value
  FROM orders JOIN customer c ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey GROUP BY ALL),
volume AS (
  SELECT CASE entity WHEN 'Issuer B Holdings' THEN 'Issuer B' ELSE entity END AS issuer, year, sum(value) AS purchase_volume
  FROM scoped GROUP BY ALL),
rates AS (
  SELECT t.issuer, t.year, t.complaints, v.purchase_volume,
    {up('t.complaints / nullif(v.purchase_volume, 0)', 2)} AS complaints_per_unit
  FROM (SELECT issuer, year, count(*) AS complaints FROM complaints GROUP BY ALL) t
  JOIN volume v ON v.issuer = t.issuer AND v.year = t.year
  WHERE t.year BETWEEN 1998 AND 2000 AND (t.issuer, t.year) NOT IN (('Issuer C', 2000), ('Issuer F', 2000)))"""

_OWN = f"issuer = {FOCUS}"
_REL = f"company_response = {q(rules.MONETARY_RELIEF)}"
RELIEF = f"""
  SELECT issue, sub_issue, count(*) FILTER ({_OWN}) AS focus_complaints,
    {pct(f'count(*) FILTER ({_OWN} AND {_REL})', f'count(*) FILTER ({_OWN})', 1)} AS focus_relief_pct,
    count(*) FILTER (issuer <> {FOCUS}) AS peers_complaints,
    {pct(f'count(*) FILTER (issuer <> {FOCUS} AND {_REL})', f'count(*) FILTER (issuer <> {FOCUS})', 1)} AS peers_relief_pct
  FROM complaints WHERE company_response <> {q(rules.IN_PROGRESS)}
  GROUP BY issue, sub_issue HAVING count(*) FILTER ({_OWN}) >= {standin.MIN_FOCUS}"""

EVIDENCE = f"""
  SELECT sub_issue, CASE WHEN {_OWN} THEN issuer ELSE 'Other issuers' END AS issuer_group, count(*) AS narratives,
    {', '.join(f'{pct_if(hit(p), 1)} AS {name}_pct' for name, p in rules.EVIDENCE_PATTERNS.items())}
  FROM complaints WHERE narrative IS NOT NULL AND value_issue IS NOT NULL GROUP BY ALL"""

_PIVOT_N = ", ".join(f'nullif(count(*) FILTER (issuer = {q(i)}), 0) AS "{i}"' for i in standin.ISSUERS.values())
_PIVOT_T = ", ".join(
    pct(f"count(*) FILTER (issuer = {q(i)} AND has_narrative)", f"count(*) FILTER (issuer = {q(i)})", 1) + f' AS "{i}"'
    for i in standin.ISSUERS.values()
)
_FIELDS = [
    "issuer", "complaint_id", "date_received", "date_sent_to_company", "product", "sub_product", "issue",
    "sub_issue", "narrative", "company_public_response", "company", "state", "zip_code", "tags",
    "submitted_via", "company_response", "timely_response", "source_file",
]
_NARR_PCT = pct_if("narrative IS NOT NULL", 1)
_THEMES = "list_filter([" + ", ".join(
    f"CASE WHEN {text_hit(r)} THEN {q(t)} END" for t, r in rules.THEME_RULES.items()
) + "], lambda x: x IS NOT NULL)"
TOLD = f"""told AS (SELECT complaint_id, issuer, date_received, narrative, {_THEMES} AS themes FROM eligible)"""
SEEDS = f"""{ELIGIBLE},{TOLD},
seeds AS (
  SELECT complaint_id, issuer, date_received, themes[1] AS theme FROM told WHERE len(themes) = 1
  QUALIFY row_number() OVER (PARTITION BY themes[1]
    ORDER BY md5('{rules.MODEL_SEED}:' || complaint_id::VARCHAR), complaint_id) <= {standin.SEED_CAP})"""

_DEDUPE = f""", again AS (
  SELECT * REPLACE ('Export_' || (complaint_id % 5 + 6) || '_again.csv' AS source_file,
                    'Again: ' || company_response AS company_response)
  FROM cards WHERE submitted_via <> 'LARGE'),
both_exports AS (SELECT * FROM cards UNION ALL SELECT * FROM again)"""

_SAMPLE_COLS = (
    "complaint_id, issuer, date_received, quarter, issue, sub_issue, company_response, narrative, stratum_size, weight"
)

SQL: dict[str, str] = {
    "volume_by_quarter": over(
        CARDS,
        body=f"""SELECT issuer, quarter, count(*) AS complaints, count(narrative) AS with_narrative,
  {_NARR_PCT} AS narrative_pct FROM complaints GROUP BY ALL""",
    ),
    "monthly_trend": over(CARDS, trend_cte(), body="SELECT * FROM trend"),
    "issue_mix": mix("issue", ""),
    "sub_issue_mix": mix("issue, sub_issue", "WHERE n > 0"),
    "response_outcomes": over(CARDS, body=OUTCOMES),
    "timely_response": over(CARDS, body=TIMELY),
    "value_issue_panel": over(CARDS, body=VALUE_PANEL),
    "rate_per_volume": over(CARDS, VOLUME_CTE, body="SELECT * FROM rates"),
    "relief_by_sub_issue": over(CARDS, body=RELIEF),
    "mentions_monthly": over(CARDS, body=MENTIONS),
    "keyword_evidence": over(CARDS, body=EVIDENCE),
    # --- profile ---
    "profile_products": over(
        CARDS,
        body="""SELECT product, sub_product, count(*) AS complaints, min(date_received) AS first_date,
  max(date_received) AS last_date FROM cards GROUP BY ALL""",
    ),
    "profile_companies": over(
        CARDS,
        body=f"""SELECT company, issuer, count(*) AS complaints, count(narrative) AS with_narrative,
  {_NARR_PCT} AS narrative_pct, min(date_received) AS first_date, max(date_received) AS last_date,
  list_position([{ISSUER_LIST}], issuer) AS ord FROM complaints GROUP BY company, issuer""",
    ),
    "profile_lookalikes": over(
        CARDS,
        body="""SELECT company, count(*) AS complaints FROM cards WHERE regexp_matches(lower(company), 'nation_[012]')
  AND company NOT IN (SELECT company FROM complaints) GROUP BY company""",
    ),
    "profile_top_companies": over(
        CARDS,
        body=f"""SELECT company, count(*) AS complaints, {pct('count(*)', '(SELECT count(*) FROM cards)', 1)} AS share_pct
  FROM cards GROUP BY company ORDER BY 2 DESC, 1 LIMIT 15""",
    ),
    "profile_pivot_volume": over(CARDS, body=f"SELECT quarter, {_PIVOT_N} FROM complaints GROUP BY quarter"),
    "profile_pivot_narrative": over(CARDS, body=f"SELECT quarter, {_PIVOT_T} FROM complaints GROUP BY quarter"),
    "profile_recent": over(
        CARDS,
        body=f"""SELECT strftime(date_received, '%Y-%m') AS month, count(*) AS complaints,
  count(narrative) AS with_narrative, {_NARR_PCT} AS narrative_pct,
  count(*) FILTER (company_response = {q(rules.IN_PROGRESS)}) AS in_progress
  FROM complaints WHERE date_received >= DATE '{standin.RECENT_FROM}' GROUP BY 1""",
    ),
    "profile_completeness": over(
        CARDS,
        body=" UNION ALL ".join(
            f"""SELECT '{f}' AS field, {pct(f'count({f})', 'count(*)', 1)} AS non_null_pct,
  count(DISTINCT {f}) AS distinct_values FROM complaints"""
            for f in _FIELDS
        ),
    ),
    "profile_text_length": over(
        CARDS,
        body=f"""SELECT quantile_cont(length(narrative), 0.1) AS p10, quantile_cont(length(narrative), 0.5) AS p50,
  quantile_cont(length(narrative), 0.9) AS p90, quantile_cont(length(narrative), 0.99) AS p99,
  max(length(narrative)) AS max_chars, {pct_if('length(narrative) > 6000', 4)} AS over_limit_pct,
  {pct_if('length(narrative) < 100', 4)} AS short_pct FROM complaints WHERE narrative IS NOT NULL""",
    ),
    "profile_responses": over(
        CARDS,
        body=f"""SELECT company_response, count(*) AS complaints,
  {pct('count(*)', '(SELECT count(*) FROM complaints)', 1)} AS share_pct FROM complaints GROUP BY 1""",
    ),
    "profile_timely": over(
        CARDS,
        body=f"""SELECT timely_response, count(*) AS complaints,
  {pct('count(*)', '(SELECT count(*) FROM complaints)', 2)} AS share_pct FROM complaints GROUP BY 1""",
    ),
    "profile_totals": over(
        CARDS,
        body=_DEDUPE
        + f"""
SELECT count(*) AS complaints, count(narrative) AS narratives, min(date_received) AS first_date,
  max(date_received) AS last_date, max(date_received) FILTER (narrative IS NOT NULL) AS last_narrative_date,
  max(date_received) FILTER (issuer = 'Issuer F') AS issuer_last_date,
  (SELECT count(*) FROM cards) AS all_card_complaints, (SELECT count(DISTINCT complaint_id) FROM cards) AS distinct_ids,
  (SELECT count(*) - count(DISTINCT complaint_id) FROM both_exports) AS repeated_rows_before_dedupe
FROM complaints""",
    ),
    "count_reconciliation": over(
        CARDS,
        body=f""", api AS (SELECT issuer, year, count(*) AS right_n FROM complaints
  WHERE timely_response IS NOT NULL GROUP BY ALL)
SELECT l.issuer, l.year, l.left_n, coalesce(api.right_n, 0) AS right_n, {pct('left_n', 'right_n', 1)} AS left_as_pct_of_right
FROM (SELECT issuer, year, count(*) AS left_n FROM complaints GROUP BY ALL) l LEFT JOIN api USING (issuer, year)""",
    ),
    # --- ingest rules ---
    "dedupe_latest": over(
        CARDS,
        body=_DEDUPE
        + """
SELECT * EXCLUDE (month, year, quarter) FROM both_exports
QUALIFY row_number() OVER (PARTITION BY complaint_id
  ORDER BY CAST(regexp_extract(source_file, '([0-9]+)_', 1) AS INT) DESC, source_file DESC) = 1""",
    ),
    "ingest_exports": over(CARDS, body="SELECT * EXCLUDE (month, year, quarter) FROM cards"),
    "ingest_in_blocks": over(CARDS, body="SELECT * EXCLUDE (month, year, quarter) FROM cards"),
    "incremental_ingest": over(CARDS, body="SELECT * EXCLUDE (month, year, quarter) FROM cards"),
    "card_filter": over(
        CARDS,
        body=f"""SELECT product, sub_product, coalesce(product = {q(rules.CARD_PRODUCT)}
   OR sub_product IN ({', '.join(q(s) for s in rules.CARD_SUB_PRODUCTS_BEFORE_RENAME)}), FALSE) AS is_card,
  count(*) AS complaints FROM mapped GROUP BY ALL""",
    ),
    "issuer_map": over(
        CARDS,
        body=f"""SELECT company, {case_map('company', standin.ISSUERS)} AS issuer, count(*) AS complaints
  FROM mapped GROUP BY ALL""",
    ),
    "file_counts": over(
        CARDS,
        body="""SELECT source_file, count(*) AS rows_total,
  count(*) FILTER (complaint_id IN (SELECT complaint_id FROM cards)) AS rows_card,
  min(date_received)::VARCHAR AS min_date_received, max(date_received)::VARCHAR AS max_date_received
FROM mapped GROUP BY source_file""",
    ),
    # --- sampling ---
    "stratified_sample": over(CARDS, SAMPLE, body=f"SELECT {_SAMPLE_COLS} FROM sample"),
    "sample_summary": over(
        CARDS,
        SAMPLE,
        body=f"""SELECT issuer, count(*) AS sampled, count(DISTINCT quarter) AS quarters,
  {up('sum(weight)', 4)} AS narratives_represented FROM sample GROUP BY issuer""",
    ),
    "keyword_themes": over(
        CARDS,
        ELIGIBLE,
        TOLD,
        body="SELECT array_to_string(themes, ',') AS themes, count(*) AS narratives FROM told GROUP BY 1",
    ),
    "keyword_seeds": over(CARDS, SEEDS, body="SELECT * FROM seeds"),
    "request_packs": over(
        CARDS,
        SAMPLE,
        body=f""", ordered AS (
  SELECT complaint_id, regexp_replace(narrative, '^\\s+|\\s+$', '', 'g') AS body,
    row_number() OVER (ORDER BY md5('{rules.PACK_SEED}:' || complaint_id::VARCHAR), complaint_id) - 1 AS pos
  FROM sample)
SELECT pos // 8 AS pack_id, array_to_string(list(complaint_id ORDER BY pos), ',') AS ids,
  string_agg('<complaint id="' || complaint_id || '">' || chr(10) ||
    body || chr(10) || '</complaint>', chr(10) || chr(10) ORDER BY pos) AS text,
  '' AS truncated_ids
FROM ordered GROUP BY 1""",
    ),
}
