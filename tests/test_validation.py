import pytest
from pyspark.sql import functions as F

from caselens.operators import validation

REVIEWS = "llm_primary_theme string, human_primary_theme string, llm_sentiment string, human_sentiment string"


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEWS)


@pytest.fixture(scope="module")
def six(spark):
    return reviews(
        spark,
        [
            ("annual_fee", "ok", "negative", "ok"), ("annual_fee", "Billing", "negative", "very negative"),
            ("billing", " YES ", "negative", ""), ("billing", "correct", "negative", None), ("billing", "", "negative", ""),
            ("billing", None, "negative", " "),
        ],
    )


@pytest.mark.parametrize(
    "entry, label",
    [(None, None), ("  ", None), (" OK ", "billing"), ("Annual fee", "annual_fee"), ("lounge_travel_benefit", "lounge_travel_benefit")],
)
def test_reviewer_entries(spark, entry, label):
    assert validation.resolve_reviews(reviews(spark, [("billing", entry, "negative", "")])).first().human == label


@pytest.mark.parametrize("theme, felt", [("fees", ""), ("", "furious"), ("negative", "")])
def test_entries_outside_the_labels_are_errors(spark, theme, felt):
    odd = reviews(spark, [("billing", theme, "negative", felt), ("billing", "ok", "negative", "ok")])
    with pytest.raises(validation.BadReviews, match=theme or felt):
        validation.resolve_reviews(odd)
    assert validation.resolve_reviews(odd, strict=False).filter("human IS NOT NULL").count() == 1


def test_scores_leave_out_unreviewed_rows(spark, six):
    done = validation.resolve_reviews(six)
    r = validation.agreement(done).first()
    assert (r.n, r.agreement) == (4, 0.75)
    per_class = {r["class"]: r for r in validation.per_class_scores(done).collect()}
    assert len(per_class) == 10
    assert per_class["annual_fee"].precision == 0.5 and per_class["billing"].recall == pytest.approx(2 / 3)
    assert per_class["other"].precision is None and per_class["other"].f1 is None
    s = validation.sentiment_agreement(done).first()
    assert (s.reviewed, s.agreement) == (2, 0.5)


def test_agreement_reweighted_to_the_population(spark, six):
    design = spark.createDataFrame([("annual_fee", 0.1), ("billing", 0.9), ("other", 0.0)], "theme string, population_share double")
    scores = validation.per_class_scores(validation.resolve_reviews(six))
    r = validation.agreement_reweighted(scores, design).first()
    assert tuple(r) == pytest.approx((0.95, 1.0))


def test_nothing_reviewed(spark, six):
    blank = validation.resolve_reviews(six.withColumn("human_primary_theme", F.lit("")))
    r = validation.agreement(blank).first()
    assert (r.n, r.agreement, r.cohen_kappa) == (0, None, None)


def test_kappa_of_a_known_confusion(spark):
    pairs = [("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 3 + [("b", "a")] + [("c", "c")]
    df = spark.createDataFrame(pairs, "human string, llm_primary_theme string")
    r = validation.agreement(df, ["a", "b", "c", "d"]).first()
    chance = (5 * 5 + 4 * 4 + 1 * 1) / 100
    assert (r.n, r.agreement) == (10, 0.8) and r.cohen_kappa == pytest.approx((0.8 - chance) / (1 - chance))
    square = {(r.human, r.model): r.n for r in validation.confusion(df, ["a", "b", "c", "d"]).collect()}
    assert len(square) == 16 and square["a", "b"] == 1 and square["d", "d"] == 0 and sum(square.values()) == 10


def test_validation_set_and_design(spark):
    rows = [(i, "A", "billing" if i % 3 else "other", 2.0 if i % 3 else 1.0) for i in range(30)]
    extra = {
        "date_received": F.lit("2024-01-01").cast("date"), "narrative": F.lit("t"), "secondary_theme": F.lit(None).cast("string"),
        "sentiment": F.lit("negative"), "named_benefits": F.array(F.lit("a"), F.lit("b")), "card_product": F.lit(None).cast("string"),
    }
    s = spark.createDataFrame(rows, "complaint_id bigint, issuer string, primary_theme string, weight double").withColumns(extra)
    vset = validation.validation_set(s, n=8)
    assert vset.count() == 8 and vset.first().llm_named_benefits == "a; b"
    design = {r.theme: (r.population_share, r.validation_rows) for r in validation.validation_design(s, vset).collect()}
    assert design == {"billing": (pytest.approx(0.8), 4), "other": (pytest.approx(0.2), 4)}
    blind = validation.validation_set(s, n=8, blind=True)
    assert not [c for c in blind.columns if c.startswith("llm_")]
    assert sorted(r.complaint_id for r in blind.collect()) == sorted(r.complaint_id for r in vset.collect())
