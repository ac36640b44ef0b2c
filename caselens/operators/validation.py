"""Label quality against human review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import share
from caselens.operators.label_parse import theme_key
from caselens.operators.sampling import balanced_draw


class BadReviews(ValueError):
    """A reviewer's entry is not one of the allowed labels."""


def validation_set(
    s: DataFrame, n: int = rules.REVIEW_ROWS, seed: int = rules.REVIEW_SEED, blind: bool = False
) -> DataFrame:
    """Rows to review, prefilled with their labels; the blind copy shows none of them."""
    filled = balanced_draw(s, "primary_theme", n, seed).select(
        "complaint_id",
        "issuer",
        "date_received",
        "narrative",
        F.col("primary_theme").alias("llm_primary_theme"),
        F.col("secondary_theme").alias("llm_secondary_theme"),
        F.col("sentiment").alias("llm_sentiment"),
        F.coalesce(F.array_join("named_benefits", "; "), F.lit("")).alias("llm_named_benefits"),
        F.col("card_product").alias("llm_card_product"),
        F.lit("").alias("human_primary_theme"),
        F.lit("").alias("human_sentiment"),
        F.lit("").alias("notes"),
    )
    return filled.drop(*[c for c in filled.columns if c.startswith("llm_")]) if blind else filled


def validation_design(s: DataFrame, vset: DataFrame) -> DataFrame:
    """Weighted share of each predicted theme and the rows drawn from it."""
    total = s.agg(F.sum("weight").alias("w")).scalar()
    population = s.groupBy(F.col("primary_theme").alias("theme")).agg(F.sum("weight").alias("w"))
    drawn = vset.groupBy(F.col("llm_primary_theme").alias("theme")).agg(F.count(F.lit(1)).alias("rows"))
    return population.join(drawn, "theme", "left").select(
        "theme",
        share("w", total).alias("population_share"),
        F.coalesce("rows", F.lit(0)).alias("validation_rows"),
    )


# --- reviewer entries --------------------------------------------------------------------
def _resolved(entry: str, predicted: str, key_of, allowed: Sequence[str]) -> tuple[Column, Column]:
    """(label the reviewer means, whether the entry is not allowed). A blank entry is no review."""
    text = F.lower(F.regexp_replace(F.col(entry), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    blank = F.coalesce(text == "", F.lit(True))
    key = key_of(text)
    known = F.coalesce(key.isin(list(allowed)), F.lit(False))
    confirmed = F.coalesce(text.isin(rules.CONFIRM_WORDS), F.lit(False))
    label = F.when(blank, F.lit(None)).when(confirmed, F.col(predicted)).when(known, key)
    return label, ~blank & ~confirmed & ~known


def resolve_reviews(reviews: DataFrame, strict: bool = True, report: int = 20) -> DataFrame:
    """Adds human and human_s, the labels the reviewer's entries stand for.

    Entries outside the allowed labels are an error that lists some of them, unless `strict` is off,
    in which case they count as not reviewed.
    """
    theme, bad_theme = _resolved("human_primary_theme", "llm_primary_theme", theme_key, rules.THEMES)
    felt, bad_felt = _resolved(
        "human_sentiment", "llm_sentiment", lambda t: F.replace(t, F.lit(" "), F.lit("_")), rules.SENTIMENTS
    )
    if strict:
        odd = reviews.select(
            F.when(bad_theme, F.col("human_primary_theme")).alias("theme"),
            F.when(bad_felt, F.col("human_sentiment")).alias("felt"),
        ).filter(F.col("theme").isNotNull() | F.col("felt").isNotNull())
        found = [v for r in odd.limit(report).collect() for v in r if v is not None]
        if found:
            raise BadReviews(f"not an allowed label: {', '.join(map(repr, found))}")
    return reviews.withColumns({"human": theme, "human_s": felt})


# --- scores ------------------------------------------------------------------------------
def _class_counts(resolved: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Reviewed rows per class by the human, by the model and by both; zero rows included."""
    human, model = F.col("human"), F.col("llm_primary_theme")

    def cell(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("class"),
            F.count_if((human == c) & (model == c)).alias("both"),
            F.count_if(human == c).alias("human_n"),
            F.count_if(human.isNotNull() & (model == c)).alias("model_n"),
        )

    return resolved.agg(F.array(*[cell(c) for c in classes]).alias("cells")).select(F.inline("cells"))


def agreement(resolved: DataFrame, classes: Sequence[str] = rules.THEMES) -> DataFrame:
    """Reviewed rows, share of agreement, Cohen's kappa (null when chance agreement is certain)."""
    totals = _class_counts(resolved, classes).agg(
        F.sum("human_n").alias("n"),
        F.sum("both").alias("both"),
        F.sum(F.col("human_n") * F.col("model_n")).alias("chance"),
    )
    seen, chance = share("both", "n"), share("chance", F.col("n") * F.col("n"))
    return totals.select("n", seen.alias("agreement"), share(seen - chance, 1.0 - chance).alias("cohen_kappa"))


def per_class_scores(resolved: DataFrame, classes: Sequence[str] = rules.THEMES) -> DataFrame:
    """Precision, recall and F1 per class; null, not zero, where a class has no rows to score."""
    precision, recall = share("both", "model_n"), share("both", "human_n")
    return (
        _class_counts(resolved, classes)
        .withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", share(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select("class", "precision", "recall", "f1", "human_n", "model_n")
    )


def agreement_reweighted(scores: DataFrame, design: DataFrame) -> DataFrame:
    """Agreement on the real mix of predicted themes, and the share of it that was reviewed."""
    covered = scores.filter(F.col("precision").isNotNull()).join(
        design, F.col("class") == F.col("theme")
    )
    w = F.sum("population_share")
    return covered.agg(
        share(F.sum(F.col("population_share") * F.col("precision")), w).alias("value"),
        F.coalesce(w, F.lit(0.0)).alias("covers_share"),
    )


def confusion(resolved: DataFrame, classes: Sequence[str] = rules.THEMES) -> DataFrame:
    """Reviewed rows per (human, model) pair of the fixed classes, zeros included."""
    counted = (
        resolved.filter(F.col("human").isNotNull())
        .groupBy("human", F.col("llm_primary_theme").alias("model"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = F.array(*[F.lit(c) for c in classes])
    square = (
        resolved.sparkSession.range(1)
        .select(F.explode(every).alias("human"))
        .select("human", F.explode(every).alias("model"))
    )
    return square.join(counted, ["human", "model"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sentiment_agreement(resolved: DataFrame) -> DataFrame:
    same = F.count_if(F.col("human_s") == F.col("llm_sentiment"))
    return resolved.agg(
        F.count("human_s").alias("reviewed"), share(same, F.count("human_s")).alias("agreement")
    )
