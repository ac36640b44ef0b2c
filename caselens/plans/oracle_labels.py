"""SQL checks of the label, cost, theme, event, validation and findings queries."""

from __future__ import annotations

from caselens.functions import rules
from caselens.operators import label_parse as lp
from caselens.operators.findings import CHART_METRICS
from caselens.plans.oracle_base import (
    CARDS,
    ELIGIBLE,
    FOCUS,
    LABELLED,
    LEDGER,
    MODEL_LABELS,
    SAMPLE,
    case_map,
    even,
    nth,
    over,
    pct,
    q,
    up,
)
from caselens.plans.oracle_benchmark import (
    EVIDENCE,
    MENTIONS,
    OUTCOMES,
    RELIEF,
    TIMELY,
    VALUE_PANEL,
    VOLUME_CTE,
    mix,
    text_hit,
    trend_cte,
)
from caselens.sources import standin

SQL: dict[str, str] = {}
THEME = nth(rules.THEMES, "zip_code::BIGINT % 10")
THEME_LABEL = case_map("theme", rules.THEME_LABELS)
ALL_THEMES = "themes AS (SELECT unnest([" + ", ".join(map(q, rules.THEMES)) + "]) AS theme)"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def wilson(k: str, n: str) -> tuple[str, str]:
    z2 = "3.8416::DOUBLE"
    p = f"({k} / {n})"
    mid = f"(({p} + {z2} / (2.0 * {n})) / (1.0 + {z2} / {n}))"
    arm = f"(1.96::DOUBLE * sqrt({p} * (1.0 - {p}) / {n} + {z2} / (4.0 * {n} * {n})) / (1.0 + {z2} / {n}))"
    return f"greatest(0.0, {mid} - {arm})", f"least(1.0, {mid} + {arm})"


# --- draws -------------------------------------------------------------------------------
DRAW = f"""
sizes AS (SELECT primary_theme AS theme, count(*) AS n,
    row_number() OVER (ORDER BY count(*), primary_theme) AS i, count(*) OVER () AS k FROM labelled GROUP BY 1),
deal AS (
  SELECT 0::BIGINT AS i, {standin.REVIEW_ROWS}::BIGINT AS remaining, 0::BIGINT AS quota, NULL::VARCHAR AS theme
  UNION ALL
  SELECT s.i, d.remaining - least(s.n, round_even(d.remaining / (s.k - s.i + 1), 0)::BIGINT),
    least(s.n, round_even(d.remaining / (s.k - s.i + 1), 0)::BIGINT), s.theme
  FROM deal d JOIN sizes s ON s.i = d.i + 1),
shuffled AS (
  SELECT l.*, row_number() OVER (PARTITION BY primary_theme
    ORDER BY md5('{rules.REVIEW_SEED}:' || complaint_id::VARCHAR), complaint_id) AS pos FROM labelled l),
vset AS (SELECT x.* FROM shuffled x JOIN deal ON deal.theme = x.primary_theme WHERE x.pos <= deal.quota)"""
SQL["balanced_draw"] = over(CARDS, LABELLED, DRAW, body="SELECT complaint_id, primary_theme FROM vset")

# --- parsed labels -----------------------------------------------------------------------
_ERRORS = {
    2: lp.UNKNOWN_THEME, 3: lp.NO_PRIMARY, 4: lp.NO_JSON, 5: lp.UNKNOWN_SENTIMENT, 6: lp.BAD_JSON,
    8: lp.THEME_NOT_TEXT, 9: lp.BENEFITS_NOT_LIST, 10: lp.NOT_TEXT, 11: lp.NOT_TEXT, 12: lp.NOT_TEXT,
}
SQL["label_parse"] = over(
    CARDS,
    body=f""", e AS (SELECT complaint_id, complaint_id % 13 AS form, {THEME} AS theme,
    CASE complaint_id % 13 {' '.join(f'WHEN {i} THEN {q(m)}' for i, m in _ERRORS.items())} END AS error FROM complaints)
SELECT complaint_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'parse_error' END AS status, error,
  CASE WHEN error IS NULL THEN theme END AS primary_theme,
  CASE WHEN form = 7 AND theme <> 'annual_fee' THEN 'annual_fee' END AS secondary_theme,
  CASE form WHEN 0 THEN 'negative' WHEN 1 THEN 'very_negative' WHEN 7 THEN 'neutral_or_mixed' END AS sentiment,
  CASE form WHEN 0 THEN 'Lounge Access;Credit' WHEN 1 THEN '' WHEN 7 THEN 'Free night' END AS named_benefits,
  CASE form WHEN 0 THEN 'Gold card' END AS card_product
FROM e""",
)
SQL["label_pack_parse"] = over(
    CARDS,
    body=f""", r AS (SELECT complaint_id, complaint_id // 8 AS pack, {THEME} AS theme FROM complaints),
s AS (SELECT *, CASE WHEN pack % 29 = 0 THEN NULL WHEN pack % 23 = 0 THEN {q(lp.NO_JSON)}
      WHEN pack % 31 = 0 THEN {q(lp.NO_RESULTS)} END AS pack_error,
    CASE WHEN complaint_id % 13 = 0 THEN {q(lp.ID_MISSING)} WHEN complaint_id % 17 = 0 THEN {q(lp.ID_TWICE)}
      WHEN complaint_id % 19 = 0 THEN {q(lp.UNKNOWN_THEME)} END AS own_error FROM r),
t AS (SELECT *, CASE WHEN pack % 29 = 0 THEN 'refusal'
    WHEN pack_error IS NOT NULL AND pack % 46 = 0 THEN 'output_cut_off' WHEN pack_error IS NOT NULL THEN 'parse_error'
    WHEN own_error = {q(lp.ID_MISSING)} THEN 'missing_in_response' WHEN own_error IS NOT NULL THEN 'parse_error'
    ELSE 'ok' END AS status FROM s)
SELECT complaint_id, 'model_0' AS model, 'v1' AS prompt_version, 'batch' AS mode, pack::VARCHAR AS pack_id, status,
  CASE WHEN status <> 'refusal' THEN coalesce(pack_error, own_error) END AS error,
  100.0::DOUBLE AS input_tokens, 50.0::DOUBLE AS output_tokens, 25.0::DOUBLE AS cache_read_tokens,
  0.0::DOUBLE AS cache_write_tokens, complaint_id = min(complaint_id) OVER (PARTITION BY pack) AS narrative_truncated,
  CASE WHEN status = 'ok' THEN theme END AS primary_theme, NULL::VARCHAR AS secondary_theme,
  CASE WHEN status = 'ok' THEN 'negative' END AS sentiment, CASE WHEN status = 'ok' THEN '' END AS named_benefits,
  NULL::VARCHAR AS card_product
FROM t""",
)

# --- ledger ------------------------------------------------------------------------------
CURRENT = """
valid AS (SELECT * FROM ledger WHERE status = 'ok' AND prompt_version = 'v1'),
current_labels AS (
  SELECT complaint_id, model, primary_theme, secondary_theme, sentiment, array_to_string(named_benefits, ';') AS named_benefits,
    card_product, narrative_truncated
  FROM valid v
  WHERE model = (SELECT model FROM valid GROUP BY model ORDER BY count(*) DESC, model DESC LIMIT 1)
    AND NOT EXISTS (SELECT 1 FROM valid w WHERE w.model = v.model AND w.complaint_id = v.complaint_id AND w.seq > v.seq))"""
FINAL = """
final AS (SELECT DISTINCT model, complaint_id FROM ledger
  WHERE prompt_version = 'v1' AND status NOT IN ('api_error', 'missing_in_response'))"""
PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(q(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" for v in row) + ")"
    for row in standin.PRICES
) + ") AS p(model, inp, outp, cread, min_cache, thinks, provider, cwrite, batch))"
_COST = "(i * inp + o * outp + r * cread + w * (inp * cwrite)) / 1e6"
_SUMS = "sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read_tokens) AS r, sum(cache_write_tokens) AS w"

SQL["current_labels"] = over(LEDGER, CURRENT, body="SELECT * FROM current_labels")
SQL["pending_rows"] = over(
    CARDS, SAMPLE, LEDGER, FINAL,
    body="""SELECT complaint_id, issuer, date_received, quarter, issue, sub_issue, company_response, narrative,
  stratum_size, weight FROM sample s
WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.model = 'model_0' AND f.complaint_id = s.complaint_id)""",
)
SQL["labelled_sample"] = over(
    CARDS, LABELLED,
    body="""SELECT * EXCLUDE (zip_code, named_benefits, weight), round_even(weight * 1e9, 0) / 1e9 AS weight,
  array_to_string(named_benefits, ';') AS named_benefits FROM labelled""",
)
SQL["labelled_sample_from_model"] = over(
    CARDS, MODEL_LABELS,
    body="""SELECT e.complaint_id, e.issuer, e.date_received, e.quarter, e.issue, e.sub_issue, e.company_response,
  1 AS stratum_size, 1.0::DOUBLE AS weight, m.primary_theme, 'llm_distilled' AS label_source, NULL::VARCHAR AS secondary_theme,
  NULL::VARCHAR AS sentiment, NULL::VARCHAR AS named_benefits, NULL::VARCHAR AS card_product
FROM eligible e JOIN model_labels m USING (complaint_id)""",
)
SQL["spend_rollup"] = over(
    LEDGER, PRICES,
    body=f"""SELECT model, mode, n AS rows, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, w AS cache_write_tokens,
  {even(f"{_COST} * CASE mode WHEN 'batch' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END", 6)} AS cost_usd
FROM (SELECT model, mode, count(*) AS n, {_SUMS} FROM ledger GROUP BY ALL) JOIN prices USING (model)""",
)
SQL["measured_cost"] = over(
    LEDGER, PRICES,
    body=f"""SELECT model, n AS billed_rows,
  CASE WHEN n >= 40 THEN {even(f"{_COST} * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / n", 9)} END AS cost_per_row_usd
FROM (SELECT model, count(*) AS n, {_SUMS} FROM ledger WHERE prompt_version = 'v1' AND status <> 'api_error' GROUP BY ALL)
JOIN prices USING (model)""",
)
SQL["ledger_status"] = over(
    LEDGER, body="SELECT model, prompt_version, mode, status, count(*) AS rows FROM ledger GROUP BY ALL"
)
_SCENARIOS = ", ".join(f"({q(n)}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in rules.COST_SCENARIOS)
SQL["cost_projection"] = over(
    CARDS, SAMPLE, LEDGER, FINAL, PRICES,
    body=f""", body AS (SELECT complaint_id, regexp_replace(narrative, '^\\s+|\\s+$', '', 'g') AS t FROM sample),
sizes AS (SELECT count(*) AS n, ceil(count(*) / 8.0)::BIGINT AS requests,
    sum(length('<complaint id="' || complaint_id || '">') + 2 + length('</complaint>')
      + length(t)) AS chars FROM body),
plan AS (
  SELECT p.*, c.scenario, s.n, s.requests, s.requests::DOUBLE AS f,
    ((s.chars + 2 * (s.n - s.requests))::DOUBLE / s.requests) / 3.3::DOUBLE + 40 AS user_tokens,
    {standin.SYSTEM_TOKENS} >= p.min_cache AS cacheable, c.hits,
    c.item * 8 + CASE WHEN p.thinks THEN c.thinking ELSE 0 END AS out_tokens
  FROM prices p, sizes s, (VALUES {_SCENARIOS}) AS c(scenario, item, thinking, hits)),
priced AS (
  SELECT *, round_even(100 * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * (
      (f * user_tokens + CASE WHEN cacheable THEN 0 ELSE f * {standin.SYSTEM_TOKENS} END) * inp + f * out_tokens * outp
      + CASE WHEN cacheable THEN f * hits * {standin.SYSTEM_TOKENS} ELSE 0 END * cread
      + CASE WHEN cacheable THEN (f - f * hits) * {standin.SYSTEM_TOKENS} ELSE 0 END * inp * cwrite) / 1e6, 0) / 100 AS usd
  FROM plan)
SELECT model, scenario, requests, usd AS cost_usd,
  n - (SELECT count(*) FROM final f JOIN sample s USING (complaint_id) WHERE f.model = priced.model) AS rows_not_in_cache,
  cacheable AS prompt_cacheable, usd <= 10.0 AS within_budget FROM priced""",
)

# --- themes ------------------------------------------------------------------------------
_LO, _HI = wilson("round_even(p * n_eff, 0)", "round_even(n_eff, 0)")
THEME_MIX = f"""{ALL_THEMES},
mix_base AS (SELECT issuer, sum(weight) AS total, count(*) AS n, sum(weight) ** 2 / sum(weight * weight) AS n_eff
  FROM labelled GROUP BY issuer),
mix_cells AS (SELECT b.*, t.theme, (SELECT count(*) FROM labelled l WHERE l.issuer = b.issuer AND l.primary_theme = t.theme) AS hits,
    coalesce((SELECT sum(weight) FROM labelled l WHERE l.issuer = b.issuer AND l.primary_theme = t.theme), 0) / b.total AS p
  FROM mix_base b, themes t),
theme_mix AS (SELECT issuer, theme, {THEME_LABEL} AS theme_label, hits AS sample_rows, n AS issuer_sample_rows,
  {even('100.0 * p', 2)} AS share_pct, {even(f'100.0 * {_LO}', 2)} AS ci_low_pct, {even(f'100.0 * {_HI}', 2)} AS ci_high_pct
  FROM mix_cells)"""
SQL["theme_mix"] = over(CARDS, LABELLED, THEME_MIX, body="SELECT * FROM theme_mix")
VS_PEERS = f"""{ALL_THEMES},
side AS (SELECT *, issuer = {FOCUS} AS own FROM labelled),
whole AS (SELECT sum(weight) FILTER (own) AS a_total, sum(weight) FILTER (NOT own) AS p_total,
    sum(weight) FILTER (own) ** 2 / sum(weight * weight) FILTER (own) AS n_eff FROM side),
vs AS (SELECT t.theme, w.n_eff, coalesce(sum(s.weight) FILTER (own), 0) / any_value(w.a_total) AS p,
    coalesce(sum(s.weight) FILTER (NOT own), 0) / any_value(w.p_total) AS peers,
    count(*) FILTER (own) AS own_rows, count(*) FILTER (NOT own) AS peer_rows
  FROM themes t CROSS JOIN whole w LEFT JOIN side s ON s.primary_theme = t.theme GROUP BY t.theme, w.n_eff),
vs_peers AS (SELECT theme, {THEME_LABEL} AS theme_label, theme IN ({', '.join(map(q, rules.VALUE_THEMES))}) AS membership_value_theme,
  {even('100.0 * p', 2)} AS focus_share_pct, {even(f'100.0 * {_LO}', 2)} AS focus_ci_low_pct,
  {even(f'100.0 * {_HI}', 2)} AS focus_ci_high_pct, {even('100.0 * peers', 2)} AS peers_share_pct,
  {even('100.0 * (p - peers)', 2)} AS diff_pts, {even('p / nullif(peers, 0)', 2)} AS index_vs_peers,
  own_rows AS focus_sample_rows, peer_rows AS peers_sample_rows FROM vs)"""
SQL["theme_vs_peers"] = over(CARDS, LABELLED, VS_PEERS, body="SELECT * FROM vs_peers")


def _relief(who: str) -> str:
    won = f"sum(weight) FILTER ({who} AND company_response = {q(rules.MONETARY_RELIEF)})"
    return even(f"100.0 * coalesce({won}, 0) / sum(weight) FILTER ({who})", 2)


_O, _P = f"issuer = {FOCUS}", f"issuer <> {FOCUS}"
SQL["theme_relief"] = over(
    CARDS, LABELLED, ALL_THEMES,
    body=f"""SELECT theme, {THEME_LABEL} AS theme_label, count(*) FILTER ({_O}) AS focus_sample_rows,
  {_relief(_O)} AS focus_relief_pct, count(*) FILTER ({_P}) AS peers_sample_rows, {_relief(_P)} AS peers_relief_pct
FROM themes LEFT JOIN labelled ON primary_theme = theme AND company_response IS DISTINCT FROM {q(rules.IN_PROGRESS)} GROUP BY theme""",
)
SENTIMENT = f"""sentiment_share AS (
  SELECT primary_theme, sentiment, {even('100.0 * sum(weight) / any_value(tw)', 2)} AS share_pct,
    {case_map('primary_theme', rules.THEME_LABELS)} AS theme_label
  FROM (SELECT *, sum(weight) OVER (PARTITION BY primary_theme) AS tw FROM labelled WHERE issuer = {FOCUS})
  WHERE sentiment IS NOT NULL GROUP BY primary_theme, sentiment)"""
SQL["theme_sentiment"] = over(CARDS, LABELLED, SENTIMENT, body="SELECT * FROM sentiment_share")


def named(values: str) -> str:
    return f"""spelled AS (SELECT CASE WHEN issuer = {FOCUS} THEN issuer ELSE 'Other issuers' END AS grp, complaint_id,
    unnest({values}) AS raw, generate_subscripts({values}, 1) AS pos FROM labelled),
tallied AS (SELECT grp, lower(trim(raw)) AS key, count(*) AS mentions, arg_min(trim(raw), complaint_id * 100 + pos) AS name
  FROM spelled WHERE trim(raw) <> '' GROUP BY 1, 2),
top_named AS (SELECT grp AS "group", name, mentions FROM tallied
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY mentions DESC, key) <= 15)"""


SQL["top_named"] = over(CARDS, LABELLED, named("named_benefits"), body="SELECT * FROM top_named")
SQL["top_products"] = over(CARDS, LABELLED, named("[card_product]"), body="SELECT * FROM top_named")
SUMMARY = """summary AS (SELECT issuer, count(*) AS sample_rows, round_even(sum(weight), 0)::BIGINT AS narratives_represented
  FROM labelled GROUP BY issuer
  UNION ALL SELECT NULL, count(*), round_even(sum(weight), 0)::BIGINT FROM labelled)"""
SQL["theme_summary"] = over(CARDS, LABELLED, SUMMARY, body="SELECT * FROM summary")
_ON_THEME = " ".join(f"WHEN {q(t)} THEN {text_hit(r, 's')}" for t, r in rules.THEME_RULES.items())
SQL["example_quotes"] = over(
    CARDS, MODEL_LABELS,
    body=rf""", flat AS (SELECT e.complaint_id, e.issuer, e.quarter, m.primary_theme AS theme,
    trim(regexp_replace(narrative, '[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS t
  FROM eligible e JOIN model_labels m USING (complaint_id) WHERE m.primary_theme <> 'other'),
cut AS (SELECT *, string_split(regexp_replace(t, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) AS parts FROM flat),
sentences AS (SELECT complaint_id, issuer, quarter, theme, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM cut),
fit AS (SELECT * FROM sentences WHERE length(s) BETWEEN 60 AND 230
  AND (length(s) - length(replace(s, 'XX', ''))) // 2 <= 1 AND NOT contains(s, '{{$')),
good AS (SELECT * FROM fit WHERE CASE theme {_ON_THEME} END
  QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY pos) = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY theme, issuer ORDER BY complaint_id) AS nth_of_issuer FROM good)
SELECT theme, complaint_id, issuer, quarter, s AS text FROM a
QUALIFY row_number() OVER (PARTITION BY theme ORDER BY nth_of_issuer > 1, issuer, complaint_id) <= 3""",
)
SQL["weighted_shares"] = over(
    CARDS, LABELLED,
    body=f"""SELECT issuer, quarter, primary_theme, {even('w', 6)} AS weight, n,
  {even('w / sum(w) OVER (PARTITION BY issuer, quarter)', 6)} AS share
FROM (SELECT issuer, quarter, primary_theme, sum(weight) AS w, count(*) AS n FROM labelled GROUP BY ALL)""",
)
SQL["timely_rate"] = over(
    CARDS,
    body=f"""SELECT issuer, {even("avg(CASE timely_response WHEN 'Yes' THEN 1.0::DOUBLE WHEN 'No' THEN 0.0::DOUBLE END)", 6)} AS rate
FROM complaints GROUP BY issuer""",
)

# --- event study -------------------------------------------------------------------------
PANELS = f"""
value_panel AS ({VALUE_PANEL}),
mentions AS ({MENTIONS}),
themed AS (SELECT issuer, date_trunc('month', date_received)::DATE AS month, count(*) AS n,
    count(*) FILTER (primary_theme IN ({', '.join(map(q, rules.VALUE_THEMES))})) AS value,
    count(*) FILTER (primary_theme = 'annual_fee') AS fee FROM model_labels GROUP BY ALL),
panels AS (
  SELECT 'sub_issue' AS lens, 'fees_rewards_promo' AS metric, issuer, month, value_complaints AS k, complaints AS n FROM value_panel
  UNION ALL SELECT 'sub_issue', 'fees', issuer, month, fees, complaints FROM value_panel
  UNION ALL SELECT 'sub_issue', 'rewards', issuer, month, rewards, complaints FROM value_panel
  UNION ALL SELECT 'mention', 'annual_fee', issuer, month, mentions_annual_fee, narratives FROM mentions
  UNION ALL SELECT 'mention', 'statement_credit', issuer, month, mentions_statement_credit, narratives FROM mentions
  UNION ALL SELECT 'theme', 'membership_value', issuer, month, value, n FROM themed
  UNION ALL SELECT 'theme', 'annual_fee', issuer, month, fee, n FROM themed),
events_list AS (SELECT * FROM (VALUES {', '.join(f"({q(k)}, {q(i)}, DATE '{m}', {q(c)})" for k, i, m, c, _ in standin.EVENTS)})
  AS e(event, treated_issuer, event_month, mention_col)),
widths AS (SELECT unnest([6, 12])::INT AS w),
controls AS (SELECT unnest([{', '.join(map(q, standin.CONTROLS))}]) AS issuer),
rel AS (SELECT p.*, e.event, e.treated_issuer, e.event_month, datediff('month', e.event_month, p.month) AS r FROM panels p, events_list e)"""
STUDY = f"""{PANELS},
cell AS (SELECT event, treated_issuer, lens, metric, w, issuer,
    coalesce(sum(k) FILTER (r BETWEEN -w AND -1), 0) AS k0, coalesce(sum(n) FILTER (r BETWEEN -w AND -1), 0) AS n0,
    coalesce(sum(k) FILTER (r BETWEEN 0 AND w - 1), 0) AS k1, coalesce(sum(n) FILTER (r BETWEEN 0 AND w - 1), 0) AS n1,
    count(DISTINCT month) FILTER (r >= 0) AS after FROM rel, widths GROUP BY ALL),
sides AS (
  SELECT event, treated_issuer, lens, metric, w, issuer AS who, NULL AS fake, k0, n0, k1, n1, 'T' AS role FROM cell WHERE issuer = treated_issuer
  UNION ALL SELECT event, treated_issuer, lens, metric, w, NULL, NULL, sum(k0), sum(n0), sum(k1), sum(n1), 'C' FROM cell
    WHERE issuer IN (SELECT issuer FROM controls) GROUP BY ALL),
fakes AS (SELECT c.event, c.lens, c.metric, c.w, {div('any_value(c.k1)', 'any_value(c.n1)')} - {div('any_value(c.k0)', 'any_value(c.n0)')}
      - ({div('sum(o.k1)', 'sum(o.n1)')} - {div('sum(o.k0)', 'sum(o.n0)')}) AS d
  FROM cell c JOIN cell o ON o.event = c.event AND o.lens = c.lens AND o.metric = c.metric AND o.w = c.w AND o.issuer <> c.issuer
  WHERE c.issuer IN (SELECT issuer FROM controls) AND o.issuer IN (SELECT issuer FROM controls)
  GROUP BY c.event, c.lens, c.metric, c.w, c.issuer),
spread AS (SELECT event, lens, metric, w, min(d) AS lo, max(d) AS hi FROM fakes GROUP BY ALL),
joined AS (SELECT t.event, t.treated_issuer, t.lens, t.metric, t.w, t.k0, t.n0, t.k1, t.n1, c.k0 AS ck0, c.n0 AS cn0, c.k1 AS ck1, c.n1 AS cn1,
    t.k0 / nullif(t.n0::DOUBLE, 0) AS tp, t.k1 / nullif(t.n1::DOUBLE, 0) AS tq, c.k0 / nullif(c.n0::DOUBLE, 0) AS cp, c.k1 / nullif(c.n1::DOUBLE, 0) AS cq,
    s.lo, s.hi, (SELECT any_value(x.after) FROM cell x WHERE x.event = t.event AND x.lens = t.lens AND x.metric = t.metric AND x.w = t.w
      AND x.issuer = t.treated_issuer) AS after, least(t.n0, t.n1, c.n0, c.n1) > 0 AS valid
  FROM sides t JOIN sides c ON c.role = 'C' AND c.event = t.event AND c.lens = t.lens AND c.metric = t.metric AND c.w = t.w
  JOIN spread s ON s.event = t.event AND s.lens = t.lens AND s.metric = t.metric AND s.w = t.w WHERE t.role = 'T'),
final_study AS (SELECT *, (tq - tp) - (cq - cp) AS d, sqrt(tp * (1 - tp) / n0 + tq * (1 - tq) / n1 + cp * (1 - cp) / cn0 + cq * (1 - cq) / cn1) AS se
  FROM joined),
study AS (SELECT event, treated_issuer, lens, metric, w AS window_months,
  {', '.join(f"CASE WHEN valid THEN {even('100.0 * ' + x, 2)} END AS {n}" for x, n in [
      ('tp', 'treated_pre_pct'), ('tq', 'treated_post_pct'), ('cp', 'control_pre_pct'), ('cq', 'control_post_pct'),
      ('(tq - tp)', 'treated_change_pts'), ('(cq - cp)', 'control_change_pts'), ('d', 'did_pts'),
      ('(d - 1.96::DOUBLE * se)', 'did_ci_low_pts'), ('(d + 1.96::DOUBLE * se)', 'did_ci_high_pts')])},
  n0::BIGINT AS n_treated_pre, n1::BIGINT AS n_treated_post, cn0::BIGINT AS n_control_pre, cn1::BIGINT AS n_control_post,
  {even('100.0 * lo', 2)} AS placebo_did_min_pts, {even('100.0 * hi', 2)} AS placebo_did_max_pts,
  coalesce(valid AND NOT (d BETWEEN lo AND hi), FALSE) AS outside_placebo_range,
  least(w, after)::BIGINT AS post_months_observed, valid FROM final_study)"""
SERIES_COLS = 'event, lens, metric, "group", month, rel_month, k, n, share_pct, share_pct_3m'


def series(source: str, name: str) -> str:
    return f"""{name}_all AS (SELECT *, {even('100.0 * k / nullif(n::DOUBLE, 0)', 2)} AS share_pct,
    {even('100.0 * sum(k) OVER last3 / nullif((sum(n) OVER last3)::DOUBLE, 0)', 2)} AS share_pct_3m
  FROM ({source}) WINDOW last3 AS (PARTITION BY event, lens, metric, "group" ORDER BY month ROWS 2 PRECEDING)),
{name} AS (SELECT {SERIES_COLS} FROM {name}_all WHERE rel_month BETWEEN -18 AND 12)"""


MONTHLY = series(
    """SELECT event, lens, metric, CASE WHEN issuer = treated_issuer THEN 'treated' ELSE 'comparison' END AS "group", month,
      r::INT AS rel_month, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n FROM rel
    WHERE issuer = treated_issuer OR issuer IN (SELECT issuer FROM controls) GROUP BY ALL""",
    "monthly",
)
NAMED_SRC = """SELECT e.event, e.treated_issuer, 'mention' AS lens, 'refreshed_card_named' AS metric, 'treated' AS "group", m.month,
      datediff('month', e.event_month, m.month)::INT AS rel_month,
      CASE e.mention_col WHEN 'mentions_platinum' THEN m.mentions_platinum ELSE m.mentions_sapphire_reserve END AS k, m.narratives AS n
    FROM mentions m JOIN events_list e ON e.treated_issuer = m.issuer"""
NAMED = series(NAMED_SRC, "named_monthly")
NAMED_STUDY = f"""named_cell AS (SELECT event, treated_issuer, lens, metric, w,
    coalesce(sum(k) FILTER (rel_month BETWEEN -w AND -1), 0)::BIGINT AS k0, coalesce(sum(n) FILTER (rel_month BETWEEN -w AND -1), 0)::BIGINT AS n0,
    coalesce(sum(k) FILTER (rel_month BETWEEN 0 AND w - 1), 0)::BIGINT AS k1, coalesce(sum(n) FILTER (rel_month BETWEEN 0 AND w - 1), 0)::BIGINT AS n1,
    count(*) FILTER (rel_month BETWEEN 0 AND w - 1) AS seen FROM ({NAMED_SRC}), widths WHERE rel_month BETWEEN -18 AND 12 GROUP BY ALL),
named_study AS (SELECT event, treated_issuer, lens, metric, w AS window_months, {even('100.0 * k0 / nullif(n0::DOUBLE, 0)', 2)} AS treated_pre_pct,
    {even('100.0 * k1 / nullif(n1::DOUBLE, 0)', 2)} AS treated_post_pct, NULL::DOUBLE AS control_pre_pct, NULL::DOUBLE AS control_post_pct,
    {even('100.0 * (k1 / nullif(n1::DOUBLE, 0) - k0 / nullif(n0::DOUBLE, 0))', 2)} AS treated_change_pts, NULL::DOUBLE AS did_pts,
    n0 AS n_treated_pre, n1 AS n_treated_post, NULL::BIGINT AS n_control_pre, NULL::BIGINT AS n_control_post, k0 AS k_treated_pre,
    k1 AS k_treated_post, seen AS post_months_observed FROM named_cell)"""
_EV = (CARDS, MODEL_LABELS)
SQL["event_panels"] = over(*_EV, PANELS, body="SELECT * FROM panels")
SQL["event_did"] = over(
    *_EV, STUDY,
    body="SELECT * EXCLUDE (placebo_did_min_pts, placebo_did_max_pts, outside_placebo_range) FROM study",
)
SQL["event_placebo"] = over(
    *_EV, STUDY,
    body="SELECT event, lens, metric, window_months, placebo_did_min_pts, placebo_did_max_pts, outside_placebo_range FROM study",
)
SQL["event_monthly"] = over(*_EV, PANELS, MONTHLY, body="SELECT * FROM monthly")
SQL["event_named_product"] = over(*_EV, PANELS, NAMED_STUDY, body="SELECT * FROM named_study")
SQL["event_named_monthly"] = over(*_EV, PANELS, NAMED, body="SELECT * FROM named_monthly")

# --- validation --------------------------------------------------------------------------
REVIEWS = f"""
reviews AS (SELECT l.complaint_id, l.primary_theme AS llm_primary_theme, l.sentiment AS llm_sentiment,
    CASE b.quality WHEN 1 THEN ' OK ' WHEN 0 THEN {nth(list(rules.THEME_LABELS.values()), '(l.zip_code::BIGINT + 1) % 10')} END AS human_primary_theme,
    CASE b.toxic WHEN 1 THEN 'very negative' WHEN 0 THEN 'yes' ELSE '' END AS human_sentiment,
    CASE b.quality WHEN 1 THEN l.primary_theme WHEN 0 THEN {nth(rules.THEMES, '(l.zip_code::BIGINT + 1) % 10')} END AS human,
    CASE b.toxic WHEN 1 THEN 'very_negative' WHEN 0 THEN l.sentiment END AS human_s
  FROM labelled l LEFT JOIN labels b ON b.doc_id = l.complaint_id % (SELECT n FROM docs_n)),
seen AS (SELECT * FROM reviews WHERE human IS NOT NULL)"""
DESIGN = """design AS (SELECT primary_theme AS theme, sum(weight) / (SELECT sum(weight) FROM labelled) AS population_share,
    (SELECT count(*) FROM vset v WHERE v.primary_theme = l.primary_theme) AS validation_rows FROM labelled l GROUP BY primary_theme)"""
SCORES = f"""{ALL_THEMES},
counted AS (SELECT theme, (SELECT count(*) FROM seen WHERE human = theme AND llm_primary_theme = theme) AS both_n,
    (SELECT count(*) FROM seen WHERE human = theme) AS human_n, (SELECT count(*) FROM seen WHERE llm_primary_theme = theme) AS model_n FROM themes),
scores AS (SELECT theme, {div('both_n', 'model_n')} AS precision, {div('both_n', 'human_n')} AS recall, human_n, model_n FROM counted)"""
SQL["validation_set"] = over(
    CARDS, LABELLED, DRAW,
    body="""SELECT complaint_id, issuer, date_received, narrative, primary_theme AS llm_primary_theme, secondary_theme AS llm_secondary_theme,
  sentiment AS llm_sentiment, coalesce(array_to_string(named_benefits, '; '), '') AS llm_named_benefits, card_product AS llm_card_product,
  '' AS human_primary_theme, '' AS human_sentiment, '' AS notes FROM vset""",
)
SQL["validation_design"] = over(
    CARDS, LABELLED, DRAW, DESIGN,
    body=f"SELECT theme, {even('population_share', 6)} AS population_share, validation_rows FROM design",
)
SQL["resolved_reviews"] = over(CARDS, LABELLED, REVIEWS, body="SELECT * FROM reviews")
SQL["agreement"] = over(
    CARDS, LABELLED, REVIEWS,
    body=f""", o AS (SELECT count(*) AS n, avg((human = llm_primary_theme)::INT) AS a FROM seen),
e AS (SELECT sum(h.c * m.c) / (SELECT n::DOUBLE * n FROM o) AS x FROM (SELECT human AS t, count(*) AS c FROM seen GROUP BY 1) h
  JOIN (SELECT llm_primary_theme AS t, count(*) AS c FROM seen GROUP BY 1) m USING (t))
SELECT n, {even('a', 6)} AS agreement, {even('(a - x) / nullif(1.0 - x, 0)', 6)} AS cohen_kappa FROM o, e""",
)
SQL["per_class_scores"] = over(
    CARDS, LABELLED, REVIEWS, SCORES,
    body=f"""SELECT theme AS class, {even('precision', 6)} AS precision, {even('recall', 6)} AS recall,
  {even(div('2.0 * precision * recall', 'precision + recall'), 6)} AS f1, human_n, model_n FROM scores""",
)
SQL["agreement_reweighted"] = over(
    CARDS, LABELLED, DRAW, DESIGN, REVIEWS, SCORES,
    body=f"""SELECT {even('sum(population_share * precision) / sum(population_share)', 6)} AS value,
  {even('sum(population_share)', 6)} AS covers_share FROM scores JOIN design USING (theme) WHERE precision IS NOT NULL""",
)
SQL["confusion"] = over(
    CARDS, LABELLED, REVIEWS, ALL_THEMES,
    body="""SELECT h.theme AS human, m.theme AS model,
  (SELECT count(*) FROM seen WHERE human = h.theme AND llm_primary_theme = m.theme) AS n FROM themes h, themes m""",
)
SQL["sentiment_agreement"] = over(
    CARDS, LABELLED, REVIEWS,
    body=f"""SELECT count(human_s) AS reviewed, {even('avg((human_s = llm_sentiment)::INT)', 6)} AS agreement
FROM reviews WHERE human_s IS NOT NULL""",
)
SQL["theme_model_share"] = over(
    CARDS, MODEL_LABELS,
    body=f"""SELECT primary_theme, {even('100.0 * count(*) / (SELECT count(*) FROM model_labels)', 1)} AS share_pct
FROM model_labels GROUP BY primary_theme""",
)


# --- findings ----------------------------------------------------------------------------
def facts(section: str, rows: list[tuple[str, str, str]], source: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{k}' AS key, NULL::VARCHAR AS subkey, ({v})::DOUBLE AS value, ({t})::VARCHAR AS text {source}"
        for k, v, t in rows
    )


SQL["facts_data"] = over(
    CARDS,
    body=facts(
        "data",
        [
            ("complaints", "SELECT count(*) FROM complaints", "NULL"),
            ("narratives", "SELECT count(narrative) FROM complaints", "NULL"),
            ("first_date", "NULL", "SELECT min(date_received) FROM complaints"),
            ("last_date", "NULL", "SELECT max(date_received) FROM complaints"),
            ("last_narrative_date", "NULL", "SELECT max(date_received) FROM complaints WHERE narrative IS NOT NULL"),
            ("focus_complaints", f"SELECT count(*) FROM complaints WHERE issuer = {FOCUS}", "NULL"),
            ("focus_narratives", f"SELECT count(narrative) FROM complaints WHERE issuer = {FOCUS}", "NULL"),
            ("issuers", "SELECT count(DISTINCT issuer) FROM complaints", "NULL"),
            ("all_card_complaints", "SELECT count(*) FROM cards", "NULL"),
        ],
    ),
)
MIX_SQL = mix("issue, sub_issue", "WHERE n > 0")
MIX_BODY = MIX_SQL[MIX_SQL.index(", src AS") :]
MIX_CTES, MIX_SELECT = MIX_BODY.rsplit("\nSELECT issuer,", 1)
MIX = f"{MIX_CTES.lstrip(', ')}, sub_mix AS (SELECT issuer,{MIX_SELECT})"
_KEYS = {v: k for k, v in rules.HEADLINE_SUB_ISSUES.items()}
SQL["facts_sub_issue"] = over(
    CARDS, MIX, f"relief AS ({RELIEF})", f"evidence AS ({EVIDENCE})",
    body=f"""SELECT {case_map('m.sub_issue', _KEYS)} AS key, m.* EXCLUDE (issuer), r.focus_relief_pct, r.peers_relief_pct,
  a.narratives AS focus_narratives, {', '.join(f'a.{p}_pct AS focus_{p}_pct, b.{p}_pct AS peers_{p}_pct' for p in rules.EVIDENCE_PATTERNS)}
FROM sub_mix m LEFT JOIN relief r ON r.issue = m.issue AND r.sub_issue = m.sub_issue
LEFT JOIN evidence a ON a.sub_issue = m.sub_issue AND a.issuer_group = {FOCUS}
LEFT JOIN evidence b ON b.sub_issue = m.sub_issue AND b.issuer_group <> {FOCUS}
WHERE m.issuer = {FOCUS} AND m.sub_issue IN ({', '.join(map(q, _KEYS))})""",
)
_OWN_RATE = f"SELECT monetary_relief_pct FROM outcomes WHERE issuer = {FOCUS}"
SQL["facts_response"] = over(
    CARDS, f"outcomes AS ({OUTCOMES})", f"timely AS ({TIMELY})",
    body=facts(
        "response",
        [
            ("focus_relief_pct", _OWN_RATE, "NULL"),
            (
                "focus_relief_rank",
                f"""SELECT floor(avg(place)) FROM (SELECT monetary_relief_pct AS m, row_number() OVER (ORDER BY monetary_relief_pct DESC) AS place
   FROM outcomes) WHERE m = ({_OWN_RATE})""",
                "NULL",
            ),
            ("timely_pct_min", "SELECT min(timely_pct) FROM timely", "NULL"),
            ("timely_pct_focus_min", f"SELECT min(timely_pct) FROM timely WHERE issuer = {FOCUS}", "NULL"),
        ],
    )
    + " UNION ALL SELECT 'response', 'relief_by_issuer', issuer, monetary_relief_pct, NULL FROM outcomes",
)
_Y = "FROM rates WHERE year = 1999"
SQL["facts_volume"] = over(
    CARDS, VOLUME_CTE,
    body=facts(
        "volume",
        [
            ("year", "SELECT 1999", "NULL"),
            ("focus_rate", f"SELECT complaints_per_unit {_Y} AND issuer = {FOCUS}", "NULL"),
            (
                "focus_rank_lowest_first",
                f"SELECT place FROM (SELECT issuer, row_number() OVER (ORDER BY complaints_per_unit, issuer) AS place {_Y}) WHERE issuer = {FOCUS}",
                "NULL",
            ),
            (
                "lowest",
                f"SELECT complaints_per_unit {_Y} ORDER BY complaints_per_unit, issuer LIMIT 1",
                f"SELECT issuer {_Y} ORDER BY complaints_per_unit, issuer LIMIT 1",
            ),
            (
                "highest",
                f"SELECT complaints_per_unit {_Y} ORDER BY complaints_per_unit DESC, issuer DESC LIMIT 1",
                f"SELECT issuer {_Y} ORDER BY complaints_per_unit DESC, issuer DESC LIMIT 1",
            ),
        ],
    ),
)
_MEASURES = [
    "treated_pre_pct", "treated_post_pct", "control_pre_pct", "control_post_pct", "treated_change_pts", "control_change_pts",
    "did_pts", "did_ci_low_pts", "did_ci_high_pts", "n_treated_pre", "n_treated_post", "n_control_pre", "n_control_post",
    "placebo_did_min_pts", "placebo_did_max_pts", "outside_placebo_range", "post_months_observed", "valid",
]
SQL["facts_events"] = over(
    *_EV, STUDY,
    body=" UNION ALL ".join(
        f"SELECT event, lens || ':' || metric AS key, window_months, '{m}' AS measure, {m}::DOUBLE AS value FROM study" for m in _MEASURES
    ),
)
_VS = [
    "focus_share_pct", "focus_ci_low_pct", "focus_ci_high_pct", "peers_share_pct", "diff_pts", "index_vs_peers",
    "focus_sample_rows", "peers_sample_rows",
]
SQL["facts_themes"] = over(
    CARDS, LABELLED, VS_PEERS, SUMMARY,
    body=" UNION ALL ".join(
        [f"SELECT 'themes' AS section, '{m}' AS key, issuer AS subkey, {m}::DOUBLE AS value FROM summary" for m in ("sample_rows", "narratives_represented")]
        + [f"SELECT 'themes', '{m}', theme, {m}::DOUBLE FROM vs_peers" for m in _VS]
    ),
)
_USED = "FROM ledger WHERE model = 'model_0' AND status <> 'api_error'"
SQL["facts_label_run"] = over(
    LEDGER,
    body=facts(
        "label_run",
        [
            ("requests_sent", f"SELECT count(DISTINCT pack_id) {_USED}", "NULL"),
            ("rows_without_valid_label", f"SELECT count(*) {_USED} AND status <> 'ok'", "NULL"),
            ("avg_output_tokens_per_row", f"SELECT {even('avg(output_tokens)', 1)} {_USED}", "NULL"),
            (
                "cache_read_share_of_input_pct",
                f"SELECT {even('100.0 * sum(cache_read_tokens) / nullif(sum(input_tokens) + sum(cache_read_tokens), 0)', 1)} {_USED}",
                "NULL",
            ),
            ("narratives_cut_for_length", f"SELECT count(*) {_USED} AND narrative_truncated", "NULL"),
        ],
    )
    + " UNION ALL SELECT 'label_run', 'rows_by_status', status, count(*)::DOUBLE, NULL FROM ledger GROUP BY status",
)
_OWN_MIX = f"SELECT * EXCLUDE (issuer) FROM sub_mix WHERE issuer = {FOCUS} AND complaints >= {standin.EXTREMES_FLOOR}"
SQL["chart_extremes"] = over(
    CARDS, MIX,
    body=f""", own_mix AS ({_OWN_MIX})
(SELECT *, 'head' AS part FROM own_mix ORDER BY diff_vs_peers_pts DESC, issue, sub_issue LIMIT 7)
UNION ALL
(SELECT *, 'tail' AS part FROM own_mix ORDER BY diff_vs_peers_pts, issue DESC, sub_issue DESC LIMIT 6)""",
)
ISSUE_SQL = mix("issue", "")
SQL["chart_issue_heat"] = f"""SELECT issuer, issue, (sum(complaints) OVER (PARTITION BY issue))::BIGINT AS all_complaints,
  {even('coalesce(share_pct, 0)', 1)} AS share_pct FROM ({ISSUE_SQL})"""
_PIVOT = ", ".join(f"max({even('share_pct', 1)}) FILTER (theme = {q(t)}) AS {t}" for t in rules.THEMES)
SQL["chart_theme_heat"] = over(CARDS, LABELLED, THEME_MIX, body=f"SELECT issuer, {_PIVOT} FROM theme_mix GROUP BY issuer")
SQL["chart_trend_index"] = over(
    CARDS, trend_cte(),
    body=f"""SELECT issuer, month, {even(f'100.0 * complaints_3m_avg / (SELECT avg(b.complaints) FROM trend b WHERE b.issuer = t.issuer AND year(b.month) = {standin.BASE_YEAR})', 1)} AS index
FROM trend t""",
)
SQL["chart_relief"] = over(
    CARDS, f"outcomes AS ({OUTCOMES})", body="SELECT issuer, monetary_relief_pct, closed_complaints FROM outcomes"
)
SQL["chart_top_benefits"] = over(
    CARDS, LABELLED, named("named_benefits"),
    body=f"""SELECT name, mentions FROM top_named WHERE "group" = {FOCUS} ORDER BY mentions DESC, lower(name) LIMIT 12""",
)
SQL["chart_very_negative"] = over(
    CARDS, LABELLED, SENTIMENT, body="SELECT theme_label, share_pct FROM sentiment_share WHERE sentiment = 'very_negative'"
)
_CHARTED = ", ".join(f"({q(a)}, {q(b)})" for a, b in CHART_METRICS)
SQL["chart_event_series"] = over(
    *_EV, STUDY, MONTHLY, NAMED, NAMED_STUDY,
    body=f""", both_monthly AS (SELECT * FROM monthly UNION ALL SELECT * FROM named_monthly),
both_study AS (SELECT event, lens, metric, window_months, treated_pre_pct, treated_post_pct, control_pre_pct, control_post_pct, did_pts FROM study
  UNION ALL SELECT event, lens, metric, window_months, treated_pre_pct, treated_post_pct, control_pre_pct, control_post_pct, did_pts FROM named_study)
SELECT m.event, m.lens, m.metric, m."group", m.month, m.share_pct_3m, s.window_months, s.treated_pre_pct, s.treated_post_pct,
  s.control_pre_pct, s.control_post_pct, s.did_pts
FROM both_monthly m LEFT JOIN both_study s ON s.event = m.event AND s.lens = m.lens AND s.metric = m.metric AND s.window_months = 6
WHERE (m.lens, m.metric) IN ({_CHARTED})""",
)
SQL["purchase_volume"] = over(VOLUME_CTE.split(",\nrates AS")[0], body="SELECT * FROM volume")
_SUB = SQL["facts_sub_issue"]
SQL["chart_relief_by_sub_issue"] = f"""SELECT issue, sub_issue, focus_relief_pct, peers_relief_pct FROM ({_SUB})
WHERE key IN ('fees', 'promo_terms', 'rewards')"""
SQL["chart_per_volume"] = over(CARDS, VOLUME_CTE, body="SELECT * FROM rates WHERE year = 1999")
_SHOWN = [
    "window_months", "treated_pre_pct", "treated_post_pct", "control_pre_pct", "control_post_pct", "did_pts",
]
_ONLY_STUDY = ["did_ci_low_pts", "did_ci_high_pts", "placebo_did_min_pts", "placebo_did_max_pts"]
SQL["chart_event_summary"] = over(
    *_EV, STUDY, NAMED_STUDY,
    body=f"""SELECT * FROM (
  SELECT event, lens, metric, {', '.join(_SHOWN + _ONLY_STUDY)} FROM study
  UNION ALL SELECT event, lens, metric, {', '.join(_SHOWN)}, NULL, NULL, NULL, NULL FROM named_study)
WHERE (lens, metric) IN ({_CHARTED})""",
)
