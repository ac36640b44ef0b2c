"""Fixed values. Results depend on these exact strings, so they are stated as they are.

Every operator takes the ones it needs as an argument, with these as the default.
"""

from __future__ import annotations

# --- bulk export layout: column name in the file -> column name here ---------------------
EXPORT_COLUMNS: dict[str, str] = {
    "Date received": "date_received",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Consumer complaint narrative": "narrative",
    "Company public response": "company_public_response",
    "Company": "company",
    "State": "state",
    "ZIP code": "zip_code",
    "Tags": "tags",
    "Submitted via": "submitted_via",
    "Date sent to company": "date_sent_to_company",
    "Company response to consumer": "company_response",
    "Timely response?": "timely_response",
    "Complaint ID": "complaint_id",
}
EXPORT_NUMBER = r"Export_(\d+)_"
EXPORT_START = "2023-01-01"

# --- card complaints and issuers ---------------------------------------------------------
CARD_PRODUCT = "Credit card"
CARD_PRODUCT_BEFORE_RENAME = "Credit card or prepaid card"
CARD_SUB_PRODUCTS_BEFORE_RENAME = [
    "General-purpose credit card or charge card",
    "Store credit card",
]
ISSUER_BY_COMPANY: dict[str, str] = {
    "AMERICAN EXPRESS COMPANY": "American Express",
    "JPMORGAN CHASE & CO.": "Chase",
    "CAPITAL ONE FINANCIAL CORPORATION": "Capital One",
    "CITIBANK, N.A.": "Citi",
    "BANK OF AMERICA, NATIONAL ASSOCIATION": "Bank of America",
    "DISCOVER BANK": "Discover",
    "SYNCHRONY FINANCIAL": "Synchrony",
}
LOOKALIKE_NAMES = "american express|amex|chase|capital one|citi|bank of america|discover|synchrony"
DENOMINATOR_ALIASES = {"JPMorgan Chase": "Chase"}
DENOMINATOR_METRIC = "purchase_volume_usd_bn"
VOLUME_YEARS = [2023, 2024, 2025]
VOLUME_EXCLUDED = [("Capital One", 2025), ("Discover", 2025)]

# --- recorded outcomes -------------------------------------------------------------------
IN_PROGRESS = "In progress"
MONETARY_RELIEF = "Closed with monetary relief"
NON_MONETARY_RELIEF = "Closed with non-monetary relief"
EXPLANATION = "Closed with explanation"
UNTIMELY = "Untimely response"

# --- sub-issues about what a card costs and what it gives back ----------------------------
VALUE_ISSUES: dict[str, str] = {
    "Problem with fees": "Fees",
    "Problem with rewards from credit card": "Rewards",
    "Didn't receive advertised or promotional terms": "Promotional terms not received",
    "Confusing or misleading advertising about the credit card": "Confusing advertising",
}
HEADLINE_SUB_ISSUES: dict[str, str] = {
    "promo_terms": "Didn't receive advertised or promotional terms",
    "rewards": "Problem with rewards from credit card",
    "fees": "Problem with fees",
    "credit_limit": "Credit card company won't increase or decrease your credit limit",
    "application_denied": "Application denied",
}

# --- keyword patterns of the monthly panel (SQL dialect) ----------------------------------
MENTION_PATTERNS: dict[str, str] = {
    "annual_fee": r"annual\s+(membership\s+)?fee|membership\s+fee",
    "platinum": r"\bplatinum\b",
    "sapphire_reserve": r"sapphire\s+reserved?\b",
    "statement_credit": r"statement\s+credits?",
    "lounge": r"\blounges?\b",
}
# --- keyword patterns of the evidence table (SQL dialect) ---------------------------------
EVIDENCE_PATTERNS: dict[str, str] = {
    "welcome_offer": r"welcome (offer|bonus)|sign[- ]?up bonus|bonus (offer|points|miles)|\d{2,3},?000 (points|miles)",
    "eligibility_wording": r"not eligible|ineligible|pop[- ]?up|once per lifetime|lifetime",
    "annual_fee": r"annual (membership )?fee|membership fee",
    "late_fee": r"late fee",
    "refund": r"refund",
    "statement_credit": r"statement credit",
    "points_lost": r"forfeit|claw|took (back|away)|removed (the|my) points|rescind",
}

# --- taxonomy -----------------------------------------------------------------------------
THEME_LABELS: dict[str, str] = {
    "annual_fee": "Annual fee",
    "statement_credit_benefit": "Statement credit or benefit redemption",
    "rewards_points": "Rewards and points",
    "lounge_travel_benefit": "Lounge or travel benefit",
    "insurance_protection_claim": "Insurance or protection claim",
    "dispute_fraud": "Dispute or fraud",
    "customer_service": "Customer service",
    "credit_limit_account_closure": "Credit limit or account closure",
    "billing": "Billing",
    "other": "Other",
}
THEMES = list(THEME_LABELS)
VALUE_THEMES = [
    "annual_fee",
    "statement_credit_benefit",
    "rewards_points",
    "lounge_travel_benefit",
    "insurance_protection_claim",
]
SENTIMENTS = ["very_negative", "negative", "neutral_or_mixed"]
NULLISH_WORDS = ["", "none", "null", "n/a", "na", "unknown", "not specified", "not stated"]
CONFIRM_WORDS = ["ok", "y", "yes", "same", "agree", "correct"]
MAX_NAMED_BENEFITS = 5

# --- keyword rule per theme (text dialect), in rule order ----------------------------------
THEME_RULES: dict[str, str] = {
    "annual_fee": r"annual (membership )?fee|yearly fee|membership fee",
    "statement_credit_benefit": (
        r"statement credits?|uber (cash|credits?)|airline (fee |incidental )?credits?|hotel credits?|"
        r"dining credits?|resy|saks|entertainment credits?|walmart\+|clear (plus )?credit|"
        r"companion (certificate|pass|ticket|fare)|free night|travel credits?|dashpass"
    ),
    "rewards_points": (
        r"\b(points|miles)\b|cash ?back|rewards?\b|welcome (bonus|offer)|sign[- ]?up bonus|"
        r"bonus (offer|points|miles)|membership rewards|ultimate rewards|thank ?you points"
    ),
    "lounge_travel_benefit": (
        r"\blounges?\b|priority pass|centurion|global entry|tsa pre|travel portal|fine hotels|"
        r"concierge|(hotel|elite) status"
    ),
    "insurance_protection_claim": (
        r"purchase protection|trip (cancell?ation|delay|interruption)|"
        r"(rental car|car rental) (insurance|coverage|damage|loss)|extended warranty|"
        r"return protection|cell ?phone protection|baggage (insurance|delay)|"
        r"benefits? administrator|travel insurance|insurance claim"
    ),
    "dispute_fraud": (
        r"dispute|chargeback|fraud|unauthori[sz]ed|identity theft|stolen|scam|did not authorize"
    ),
    "customer_service": (
        r"customer service|representative|supervisor|on hold|hung up|rude|call(ed)? (me )?back"
    ),
    "credit_limit_account_closure": (
        r"credit (limit|line)|clos(ed|ing|ure) (of )?(my |the |our )?(account|card)|"
        r"account (was |has been |is )?(closed|suspended|restricted|cancell?ed)|financial review|"
        r"application (was |has been )?denied|denied (my|the) application"
    ),
    "billing": (
        r"late fees?|interest|\bapr\b|auto ?pay|minimum payment|balance transfer|"
        r"statement balance|credit (report|bureaus?)|collections?|payment (was|did|posted|not)"
    ),
}

# --- lower-case fragments: any text a pattern above matches holds at least one of its fragments ---
MENTION_FRAGMENTS: dict[str, list[str]] = {
    "annual_fee": ["annual", "membership"],
    "platinum": ["platinum"],
    "sapphire_reserve": ["sapphire"],
    "statement_credit": ["statement"],
    "lounge": ["lounge"],
}
EVIDENCE_FRAGMENTS: dict[str, list[str]] = {
    "welcome_offer": ["welcome ", "bonus", "000 points", "000 miles"],
    "eligibility_wording": ["eligible", "popup", "pop-up", "pop up", "lifetime"],
    "annual_fee": ["annual fee", "membership fee"],
    "late_fee": ["late fee"],
    "refund": ["refund"],
    "statement_credit": ["statement credit"],
    "points_lost": ["forfeit", "claw", "took back", "took away", "removed ", "rescind"],
}
THEME_FRAGMENTS: dict[str, list[str]] = {
    "annual_fee": ["annual fee", "membership fee", "yearly fee"],
    "statement_credit_benefit": [
        "statement credit", "uber c", "airline ", "hotel credit", "dining credit", "resy", "saks",
        "entertainment credit", "walmart+", "clear credit", "clear plus credit", "companion ",
        "free night", "travel credit", "dashpass",
    ],
    "rewards_points": ["points", "miles", "cashback", "cash back", "reward", "welcome ", "bonus"],
    "lounge_travel_benefit": [
        "lounge", "priority pass", "centurion", "global entry", "tsa pre", "travel portal",
        "fine hotels", "concierge", "hotel status", "elite status",
    ],
    "insurance_protection_claim": [
        "purchase protection", "trip ", "rental car ", "car rental ", "extended warranty",
        "return protection", "phone protection", "baggage ", "administrator", "travel insurance",
        "insurance claim",
    ],
    "dispute_fraud": [
        "dispute", "chargeback", "fraud", "unauthori", "identity theft", "stolen", "scam",
        "did not authorize",
    ],
    "customer_service": [
        "customer service", "representative", "supervisor", "on hold", "hung up", "rude", "call",
    ],
    "credit_limit_account_closure": [
        "credit li", "closed", "closing", "closure", "suspended", "restricted", "canceled",
        "cancelled", "financial review", "application ", "denied ",
    ],
    "billing": [
        "late fee", "interest", "apr", "autopay", "auto pay", "minimum payment", "balance transfer",
        "statement balance", "credit report", "credit bureau", "collection", "payment ",
    ],
}

# --- sampling ------------------------------------------------------------------------------
SAMPLE_SEED = 20260930
SAMPLE_UNTIL = "2026-07-31"
SAMPLE_MIN_CHARS = 80
SAMPLE_CAPS = {"American Express": 80, "Chase": 60}
SAMPLE_DEFAULT_CAP = 32
REVIEW_ROWS = 150
REVIEW_SEED = 150
SEED_CAP_PER_THEME = 6000
MODEL_SEED = 7
PACK_SIZE = 8
PACK_SEED = 17
MAX_NARRATIVE_CHARS = 6000
CUT_MARKER = "\n[narrative cut here for length]"

# --- label sources ---------------------------------------------------------------------------
FROM_LABELS = "llm"
FROM_DISTILLED_MODEL = "llm_distilled"
FROM_KEYWORD_MODEL = "keyword_fallback"
MIN_LABEL_COVERAGE = 0.85
MIN_LABELS_TO_DISTIL = 1000
RETRIED_STATUSES = ["api_error", "missing_in_response"]

# --- cost planning ------------------------------------------------------------------------------
BATCH_DISCOUNT = 0.5
BUDGET_USD = 10.0
CHARS_PER_TOKEN = 3.3
PACK_OVERHEAD_TOKENS = 40
COST_SCENARIOS = [
    # name, output tokens per item, thinking tokens per pack, cache hit rate
    ("low", 60, 0, 0.95),
    ("expected", 75, 300, 0.7),
    ("high", 100, 1200, 0.0),
]
MIN_ROWS_FOR_MEASURED_COST = 40

# --- event study -----------------------------------------------------------------------------
EVENTS = [
    # key, treated issuer, event month, mention column of the product named, product name
    ("chase_sapphire_reserve", "Chase", "2025-06-01", "mentions_sapphire_reserve", "Sapphire Reserve"),
    ("amex_platinum", "American Express", "2025-09-01", "mentions_platinum", "Platinum"),
]
CONTROL_ISSUERS = ["Capital One", "Citi", "Bank of America", "Discover", "Synchrony"]
EVENT_WINDOWS = [6, 12]
SERIES_FROM_MONTH, SERIES_TO_MONTH = -18, 12

# --- quotes -------------------------------------------------------------------------------------
QUOTE_MIN_CHARS, QUOTE_MAX_CHARS = 60, 230
QUOTES_PER_THEME = 3
