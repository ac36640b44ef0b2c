"""Weighted stratified sampling, balanced draws, keyword seeds and request packs.

Draws follow a seeded md5 of the row id, so they are the same on any partitioning. A group that holds
most of the rows never sits in one task (see `first_ranks` and `shuffled_rank`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import lookup, quarter_label
from caselens.functions.frames import first_ranks, keep, shuffled_rank, small_or_plain
from caselens.operators.keywords import with_keyword_themes

SAMPLE_COLUMNS = [
    "complaint_id", "issuer", "date_received", "quarter", "issue", "sub_issue", "company_response",
    "narrative",
]


def eligible_narratives(
    c: DataFrame,
    min_chars: int = rules.SAMPLE_MIN_CHARS,
    until: str = rules.SAMPLE_UNTIL,
    also: Sequence[str | Column] = (),
) -> DataFrame:
    """Complaints whose narrative is long enough to say something, up to a date."""
    return c.filter(
        F.col("narrative").isNotNull()
        & (F.length("narrative") >= min_chars)
        & (F.col("date_received") <= F.lit(until).cast("date"))
    ).select(
        *[quarter_label("date_received").alias(n) if n == "quarter" else n for n in SAMPLE_COLUMNS], *also
    )


def stratified_sample(
    pool: DataFrame,
    strata: Sequence[str] = ("issuer", "quarter"),
    caps: dict[str, int] = rules.SAMPLE_CAPS,
    default_cap: int = rules.SAMPLE_DEFAULT_CAP,
    seed: int = rules.SAMPLE_SEED,
    row_id: str = "complaint_id",
) -> DataFrame:
    """Up to `cap` rows of every stratum, with stratum_size and weight = size / rows drawn.

    The cap is looked up by the first stratum column. Only ids and strata are ranked; the rows of the
    drawn ids are fetched afterwards, by broadcast when their count allows it and by shuffle beyond.
    """
    strata = list(strata)
    narrow = pool.select(row_id, *strata)
    sizes = narrow.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))
    cap = F.coalesce(lookup(F.col(strata[0]), {k: str(v) for k, v in caps.items()}).cast("int"), F.lit(default_cap))
    top = max([default_cap, *caps.values()])
    drawn = first_ranks(narrow, row_id, seed, strata, top, "_rank").filter(F.col("_rank") <= cap).drop("_rank")
    weight = F.col("stratum_size") / F.least(F.col("stratum_size"), cap).cast("double")
    weighted = drawn.join(sizes, strata).withColumn("weight", weight).drop(*strata)
    return pool.join(small_or_plain(keep(weighted, "drawn")), row_id)


def sample_summary(sample: DataFrame) -> DataFrame:
    return sample.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_distinct("quarter").alias("quarters"),
        F.sum("weight").alias("narratives_represented"),
    )


def balanced_quotas(df: DataFrame, class_col: str, n: int) -> DataFrame:
    """Rows to take from each class of a fixed label set so that about n come out.

    Smallest classes go first; what they cannot fill is spread over the classes after them.
    """
    sizes = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("size"))
    ascending = F.sort_array(F.collect_list(F.struct("size", F.col(class_col).alias("class"))))
    start = F.struct(
        F.lit(n).cast("bigint").alias("left"),
        F.array().cast("array<struct<class:string,quota:bigint>>").alias("quotas"),
    )

    def give(state, item):
        waiting = F.size("classes") - F.size(state["quotas"])
        quota = F.least(item["size"], F.rint(state["left"] / waiting).cast("bigint"))
        return F.struct(
            (state["left"] - quota).alias("left"),
            F.array_append(
                state["quotas"], F.struct(item["class"].alias("class"), quota.alias("quota"))
            ).alias("quotas"),
        )

    return (
        sizes.agg(ascending.alias("classes"))
        .select(F.aggregate("classes", start, give)["quotas"].alias("quotas"))
        .select(F.inline("quotas"))
        .withColumnRenamed("class", class_col)
    )


def balanced_draw(
    df: DataFrame,
    class_col: str = "primary_theme",
    n: int = rules.REVIEW_ROWS,
    seed: int = rules.REVIEW_SEED,
    row_id: str = "complaint_id",
) -> DataFrame:
    """About n rows spread evenly over the classes; small classes give all they have."""
    return (
        first_ranks(df, row_id, seed, [class_col], n, "_rank")
        .join(balanced_quotas(df, class_col, n), class_col)
        .filter(F.col("_rank") <= F.col("quota"))
        .select(*df.columns)
    )


def seeds_of(
    tagged: DataFrame,
    themes: str,
    cap: int = rules.SEED_CAP_PER_THEME,
    seed: int = rules.MODEL_SEED,
    row_id: str = "complaint_id",
) -> DataFrame:
    """Rows whose array of matched themes has exactly one, as `theme`, at most `cap` per theme."""
    # Exploding a one-element array, or null, filters without matching the rules a second time.
    only = F.when(F.size(themes) == 1, F.col(themes))
    single = tagged.select(row_id, F.explode(only).alias("theme"))
    drawn = first_ranks(keep(single, "single"), row_id, seed, ["theme"], cap, "_rank").drop("_rank")
    return tagged.drop(themes).join(small_or_plain(keep(drawn, "seeds")), row_id)


def keyword_seeds(
    corpus: DataFrame,
    cap: int = rules.SEED_CAP_PER_THEME,
    seed: int = rules.MODEL_SEED,
    row_id: str = "complaint_id",
) -> DataFrame:
    """Rows that match the rule of exactly one theme, at most `cap` per theme."""
    return seeds_of(with_keyword_themes(corpus, "narrative", "_themes"), "_themes", cap, seed, row_id)


def prepared_text(narrative, max_chars: int | None = None):
    """(text as sent, whether it was cut): white space around it removed; cut with a marker if a limit is given."""
    text = F.regexp_replace(narrative, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    if max_chars is None:
        return text, F.lit(False)
    cut = F.length(text) > max_chars
    return F.when(cut, F.concat(F.substring(text, 1, max_chars), F.lit(rules.CUT_MARKER))).otherwise(text), cut


def request_blocks(rows: DataFrame, max_chars: int | None = None, row_id: str = "complaint_id") -> DataFrame:
    """Each row's block of a request: id, block text and whether the narrative was cut."""
    text, cut = prepared_text(F.col("narrative"), max_chars)
    block = F.concat(
        F.lit('<complaint id="'), F.coalesce(F.col(row_id).cast("string"), F.lit("")), F.lit('">\n'), text, F.lit("\n</complaint>")
    )
    return rows.select(row_id, block.alias("block"), cut.alias("cut"))


def request_packs(
    rows: DataFrame,
    pack_size: int = rules.PACK_SIZE,
    max_chars: int | None = None,
    seed: int = rules.PACK_SEED,
    row_id: str = "complaint_id",
) -> DataFrame:
    """Rows in seeded random order, cut into packs of `pack_size`; each row is in one pack, with its whole text
    unless `max_chars` limits it.

    Packs are numbered over all rows without a global sort. A pack is one group of at most pack_size.
    """
    # Rows are ranked, not ids: equal ids and null ones are rows like all others.
    ranked = shuffled_rank(request_blocks(rows, max_chars, row_id), row_id, seed)
    item = F.struct("rank", row_id, "block", "cut")
    packs = (
        ranked.groupBy(F.floor((F.col("rank") - 1) / pack_size).cast("bigint").alias("pack_id"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    cut_items = F.filter("items", lambda x: x["cut"])
    return packs.select(
        "pack_id",
        F.col(f"items.{row_id}").alias("ids"),
        F.array_join("items.block", "\n\n").alias("text"),
        F.transform(cut_items, lambda x: x[row_id]).alias("truncated_ids"),
    )
