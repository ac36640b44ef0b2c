import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselens.functions import exprs, rules
from caselens.operators.keywords import with_keyword_themes

FAMILIES = [
    (rules.MENTION_PATTERNS, rules.MENTION_FRAGMENTS),
    (rules.EVIDENCE_PATTERNS, rules.EVIDENCE_FRAGMENTS),
    (rules.THEME_RULES, rules.THEME_FRAGMENTS),
]
PAIRS = [(p[name], f[name]) for p, f in FAMILIES for name in p]


@pytest.mark.parametrize("pattern, fragments", PAIRS)
def test_every_match_holds_a_fragment(pattern, fragments):
    ascii_text = re.compile(pattern, re.IGNORECASE | re.ASCII)

    @settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(ascii_text, fullmatch=False, alphabet=st.characters(max_codepoint=127)))
    def check(text):
        assert any(f in text.lower() for f in fragments)

    check()


def themes_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, narrative string")
    return [r.themes for r in with_keyword_themes(df).orderBy("i").collect()]


def test_rules_fire_on_clear_cases(spark):
    got = themes_of(
        spark,
        "They put my annual FEE up again",
        "That airline fee credit is missing",
        "No seat in the Centurion lounge",
        "A trip interruption was not paid",
        "Someone made an unauthorised purchase",
        "It rained all Tuesday",
        "A late fee, then the supervisor hung up, then a chargeback",
    )
    assert got == [
        ["annual_fee"], ["statement_credit_benefit"], ["lounge_travel_benefit"], ["insurance_protection_claim"],
        ["dispute_fraud"], [], ["dispute_fraud", "customer_service", "billing"],
    ]


def test_lookalike_letters_reach_the_regex(spark):
    scam = exprs.unicode_regex("scam")
    df = exprs.with_search_columns(spark.createDataFrame([("ſcam",), ("FEEſ K",), ("none",)], "t string"), "t")
    got = df.select(exprs.matches("t", scam, ["scam"]).alias("a"), F.col("t").rlike(scam).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, True), (False, False), (False, False)]


def test_no_cut_of_long_texts(spark):
    assert themes_of(spark, "word " * 40_000 + "and at last an identity theft") == [["dispute_fraud"]]


def test_a_callers_own_rules_need_no_fragments(spark):
    from caselens.operators.keywords import with_keyword_themes

    df = spark.createDataFrame([(1, "An annuity was sold"), (2, "annual fee"), (3, None)], "id int, narrative string")
    own = {"annual_fee": r"\bannuity\b", "brand_new": r"\bsold\b"}
    got = {r.id: r.themes for r in with_keyword_themes(df, themes=own).collect()}
    assert got == {1: ["annual_fee", "brand_new"], 2: [], 3: []}
