"""What labelling has cost and would cost, from token counts and a price table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import round_even
from caselens.operators.labels import final_attempts
from caselens.operators.sampling import request_blocks

USAGE = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def usage_cost(inp: Column, out: Column, cache_read: Column, cache_write: Column, batch: Column) -> Column:
    """USD for token counts, with the price columns of the same row (USD per million tokens)."""
    write_price = F.col("input") * F.col("cache_write_multiplier")
    usd = (inp * F.col("input") + out * F.col("output") + cache_read * F.col("cache_read") + cache_write * write_price) / 1e6
    return usd * F.when(batch, rules.BATCH_DISCOUNT).otherwise(1.0)


def within_budget(spent: Column, projected: Column, budget: float = rules.BUDGET_USD) -> Column:
    return spent + projected <= budget


def spend_rollup(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per model and mode; batch requests are discounted."""
    used = ledger.groupBy("model", "mode").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in USAGE]
    )
    cost = usage_cost(*[F.col(c) for c in USAGE], F.col("mode") == "batch")
    return used.join(prices, "model").select("model", "mode", "rows", *USAGE, cost.alias("cost_usd"))


def measured_cost(
    ledger: DataFrame,
    prices: DataFrame,
    prompt_version: str,
    min_rows: int = rules.MIN_ROWS_FOR_MEASURED_COST,
) -> DataFrame:
    """Average cost per row from billed attempts, per model; null until enough rows were billed."""
    billed = (
        ledger.filter((F.col("prompt_version") == prompt_version) & (F.col("status") != "api_error"))
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("billed_rows"), *[F.sum(c).alias(c) for c in USAGE])
    )
    cost = usage_cost(*[F.col(c) for c in USAGE], F.col("batch"))
    per_row = F.when(F.col("billed_rows") >= min_rows, cost / F.col("billed_rows"))
    return billed.join(prices, "model").select("model", "billed_rows", per_row.alias("cost_per_row_usd"))


def full_sample_cost(sample: DataFrame, per_row: DataFrame) -> DataFrame:
    """Cost of labelling the whole sample at each model's measured cost per row; null where too few rows were billed."""
    rows = sample.agg(F.count(F.lit(1)).alias("n")).scalar()
    cost = F.col("cost_per_row_usd")
    return per_row.select(
        "model",
        round_even(cost, 5).alias("measured_cost_per_row_usd"),
        round_even(cost * rows, 2).alias("full_sample_cost_usd"),
    )


def ledger_status(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model", "prompt_version", "mode", "status").agg(F.count(F.lit(1)).alias("rows"))


def request_sizes(
    sample: DataFrame, pack_size: int = rules.PACK_SIZE, max_chars: int | None = None
) -> DataFrame:
    """One row: sample_rows, requests, and average characters per request, without building packs.

    A request's text is its blocks with one blank line between two of them.
    """
    blocks = request_blocks(sample, max_chars)
    sizes = blocks.agg(F.count(F.lit(1)).alias("sample_rows"), F.sum(F.length("block")).alias("chars"))
    requests = F.ceil(F.col("sample_rows") / pack_size)
    gaps = 2 * (F.col("sample_rows") - F.col("requests"))
    return sizes.withColumn("requests", requests).select(
        "sample_rows",
        "requests",
        F.try_divide((F.col("chars") + gaps).cast("double"), F.col("requests")).alias("avg_chars"),
    )


def cost_projection(
    sample: DataFrame,
    ledger: DataFrame,
    prices: DataFrame,
    system_tokens: int,
    prompt_version: str,
    scenarios: Sequence[tuple] = rules.COST_SCENARIOS,
    budget: float = rules.BUDGET_USD,
    pack_size: int = rules.PACK_SIZE,
) -> DataFrame:
    """Cost of labelling the whole sample per model and scenario, and rows a model still lacks.

    A shared prompt shorter than the model's cacheable minimum is plain input on every request.
    """
    sizes = request_sizes(sample, pack_size).agg(F.first(F.struct("*")).alias("s"))
    done = (
        final_attempts(ledger, prompt_version)
        .join(sample.select("complaint_id"), "complaint_id", "left_semi")
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("cached"))
    )
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(per_item).alias("item_tokens"),
                F.lit(thinking).alias("thinking_tokens"),
                F.lit(float(hits)).alias("hit_rate"),
            )
            for name, per_item, thinking, hits in scenarios
        ]
    )
    grid = (
        prices.join(done, "model", "left")
        .withColumn("s", sizes.scalar())
        .select("*", F.inline(listed))
        .select("*", "s.sample_rows", "s.requests", "s.avg_chars")
    )
    n = F.col("requests").cast("double")
    system = F.lit(float(system_tokens))
    cacheable = F.lit(system_tokens) >= F.col("min_cacheable_tokens")
    user = n * (F.col("avg_chars") / rules.CHARS_PER_TOKEN + rules.PACK_OVERHEAD_TOKENS)
    per_pack = F.col("item_tokens") * pack_size + F.when(F.col("thinks"), F.col("thinking_tokens")).otherwise(0)
    hits = F.when(cacheable, n * F.col("hit_rate")).otherwise(0.0)
    misses = F.when(cacheable, n - n * F.col("hit_rate")).otherwise(0.0)
    plain = user + F.when(cacheable, 0.0).otherwise(n * system)
    cost = usage_cost(plain, n * per_pack, hits * system, misses * system, F.col("batch"))
    usd = F.rint(F.coalesce(cost, F.lit(0.0)) * 100) / 100
    return grid.select(
        "model",
        "scenario",
        "requests",
        usd.alias("cost_usd"),
        (F.col("sample_rows") - F.coalesce("cached", F.lit(0))).alias("rows_not_in_cache"),
        cacheable.alias("prompt_cacheable"),
        within_budget(F.lit(0.0), usd, budget).alias("within_budget"),
    )
