"""The label ledger: which labels are current, which rows still need one, which source is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.frames import small_or_plain

LABEL_COLUMNS = [
    "complaint_id", "model", "primary_theme", "secondary_theme", "sentiment", "named_benefits",
    "card_product", "narrative_truncated",
]
ONLY_FROM_LABELS = {
    "secondary_theme": "string",
    "sentiment": "string",
    "named_benefits": "array<string>",
    "card_product": "string",
}


def current_labels(ledger: DataFrame, prompt_version: str, model: str | None = None) -> DataFrame:
    """The last valid label per complaint under the current prompt, from one model.

    That model is the one asked for if it has valid labels, else the one with most of them.
    """
    valid = ledger.filter((F.col("status") == "ok") & (F.col("prompt_version") == prompt_version))
    wanted = F.col("model").eqNullSafe(F.lit(model)).cast("int")
    chosen = (
        valid.groupBy("model")
        .agg(F.count(F.lit(1)).alias("labels"))
        .agg(F.max_by("model", F.struct(wanted, "labels", "model")).alias("model"))
        .scalar()
    )
    # Attempts with the same place are ordered by their content, so the choice never depends on row order.
    last = Window.partitionBy("complaint_id").orderBy(F.desc_nulls_last("seq"), F.desc(F.xxhash64(*LABEL_COLUMNS)))
    return (
        valid.filter(F.col("model") == chosen)
        .withColumn("_n", F.row_number().over(last))
        .filter("_n = 1")
        .select(*LABEL_COLUMNS)
    )


def final_attempts(ledger: DataFrame, prompt_version: str) -> DataFrame:
    """(model, complaint) pairs that are not sent again: every status but the transient ones."""
    return (
        ledger.filter(
            (F.col("prompt_version") == prompt_version)
            & ~F.col("status").isin(rules.RETRIED_STATUSES)
        )
        .select("model", "complaint_id")
        .distinct()
    )


def pending_rows(sample: DataFrame, ledger: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Sampled rows without a final attempt by this model under this prompt."""
    done = final_attempts(ledger.filter(F.col("model") == model), prompt_version)
    return sample.join(done, "complaint_id", "left_anti")


def labelled_sample(
    sample: DataFrame,
    labels: DataFrame,
    model_labels: DataFrame,
    min_coverage: float = rules.MIN_LABEL_COVERAGE,
    source: str | None = None,
) -> DataFrame:
    """The sample with a theme per row, from "labels" or from the "model"; left out, from labels if they cover enough.

    With labels, weights become stratum size / labelled rows, so a stratum keeps its full weight when
    some of its rows have no valid label.
    """
    if source is None:
        source = "labels" if labels.count() >= min_coverage * sample.count() else "model"
    if source not in ("labels", "model"):
        raise ValueError(f"unknown source {source!r}")
    if source == "labels":
        rows = sample.join(labels.drop("model"), "complaint_id")
        per_stratum = rows.groupBy("issuer", "quarter").agg(F.count(F.lit(1)).alias("_labelled"))
        return (
            rows.join(per_stratum, ["issuer", "quarter"])
            .withColumn("weight", F.col("stratum_size") / F.col("_labelled"))
            .withColumn("label_source", F.lit(rules.FROM_LABELS))
            .select(*sample.columns, *labels.drop("complaint_id", "model").columns, "label_source")
        )
    # Model labels cover the whole corpus; only those of sampled rows take part in the join.
    wanted = model_labels.select("complaint_id", "primary_theme", "label_source").join(
        small_or_plain(sample.select("complaint_id")), "complaint_id", "left_semi"
    )
    rows = sample.join(wanted, "complaint_id")
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in ONLY_FROM_LABELS.items()})
