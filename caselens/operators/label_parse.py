"""Checking returned labels: JSON text to typed label columns or a typed error, without UDFs.

Responses are parsed to VARIANT, so a number or a list where text belongs is seen as such and
rejected, not coerced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import as_col, lookup, made_once, one_spaced

# Rows below are checked in this order; the first problem found is the row's error.
NO_JSON = "no JSON object found"
BAD_JSON = "invalid JSON"
NO_RESULTS = "response has no results list"
NO_PRIMARY = "missing primary_theme"
THEME_NOT_TEXT = "theme must be a string"
UNKNOWN_THEME = "unknown theme"
NOT_TEXT = "expected text or null"
UNKNOWN_SENTIMENT = "unknown sentiment"
BENEFITS_NOT_LIST = "named_benefits must be a list"
ID_MISSING = "id missing from response"
ID_TWICE = "id appears more than once in response"

USAGE = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
LABELS = ["primary_theme", "secondary_theme", "sentiment", "named_benefits", "card_product"]


# --- scalar pieces -----------------------------------------------------------------------
def snake_key(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def theme_key(text: Column, labels: dict[str, str] = rules.THEME_LABELS) -> Column:
    """Theme key of a key or display label in any spelling; null when it is neither."""
    key = snake_key(text)
    by_label = {
        "_".join("".join(ch if ch.isalnum() else " " for ch in label.lower()).split()): k
        for k, label in labels.items()
    }
    return F.coalesce(F.when(key.isin(list(labels)), key), lookup(key, by_label))


def json_object(raw: Column) -> Column:
    """The text from the first { to the last }; empty when there is none."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def _kind(v: Column) -> Column:
    """Type of a variant: VOID for JSON null, OBJECT and ARRAY without their contents; null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _absent(v: Column) -> Column:
    return v.isNull() | (_kind(v) == "VOID")


def _clean(text: Column) -> Column:
    """White space collapsed; null for words that stand for nothing."""
    spaced = one_spaced(text)
    return F.when(~F.lower(spaced).isin(rules.NULLISH_WORDS), spaced)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _unique(values: Column) -> Column:
    """First spelling of each value, ignoring case, in order."""
    def add(found: Column, value: Column) -> Column:
        again = F.exists(found, lambda f: F.lower(f) == F.lower(value))
        return F.when(again, found).otherwise(F.array_append(found, value))

    return F.aggregate(values, F.array().cast("array<string>"), add)


# --- one label ---------------------------------------------------------------------------
def check_items(df: DataFrame, item: str, problem: Column, max_benefits: int | None = None) -> DataFrame:
    """Adds error and the label columns read from the variant column `item`.

    `problem` is an error already known for the row; it wins over anything found here. All named benefits are
    kept unless `max_benefits` limits them.
    """
    v = F.col(item)
    fields = {f"_{n}": _field(v, n) for n in LABELS}
    primary, second, felt, named, product = (F.col(f"_{n}") for n in LABELS)
    items = (
        F.when(_kind(named) == "STRING", F.array(named))
        .when(_kind(named) == "ARRAY", F.try_variant_get(named, "$", "array<variant>"))
        .otherwise(F.array().cast("array<variant>"))
    )
    # A JSON null inside an array may come back as a plain null.
    odd_item = F.exists("_items", lambda x: ~_absent(x) & (_kind(x) != "STRING"))
    cleaned = F.transform("_items", lambda x: F.when(~_absent(x), _clean(_text(x))))
    benefits = _unique(F.array_compact(cleaned))
    parsed = (
        df.withColumns(fields)
        .withColumn("_items", items)
        .withColumns(
            {
                "_p": theme_key(_text(primary)),
                "_s_text": F.when(_kind(second) == "STRING", _clean(_text(second))),
                "_f": snake_key(F.coalesce(_text(felt), F.lit(""))),
                "_b": benefits if max_benefits is None else F.slice(benefits, 1, max_benefits),
                "_c": F.when(_kind(product) == "STRING", _clean(_text(product))),
            }
        )
        .withColumn("_s", theme_key(F.col("_s_text")))
    )
    error = (
        F.when(problem.isNotNull(), problem)
        .when(primary.isNull(), NO_PRIMARY)
        .when(_kind(primary) != "STRING", THEME_NOT_TEXT)
        .when(F.col("_p").isNull(), UNKNOWN_THEME)
        .when(~_absent(second) & (_kind(second) != "STRING"), NOT_TEXT)
        .when(F.col("_s_text").isNotNull() & F.col("_s").isNull(), UNKNOWN_THEME)
        .when(~F.col("_f").isin(rules.SENTIMENTS), UNKNOWN_SENTIMENT)
        .when(~_absent(named) & ~_kind(named).isin("STRING", "ARRAY"), BENEFITS_NOT_LIST)
        .when(odd_item, NOT_TEXT)
        .when(~_absent(product) & (_kind(product) != "STRING"), NOT_TEXT)
    )
    good = F.col("error").isNull()
    values = {
        "primary_theme": F.col("_p"),
        "secondary_theme": F.when(F.col("_s") != F.col("_p"), F.col("_s")),
        "sentiment": F.col("_f"),
        "named_benefits": F.col("_b"),
        "card_product": F.col("_c"),
    }
    return (
        parsed.withColumn("error", error)
        .withColumns({n: F.when(good, value) for n, value in values.items()})
        .drop(*fields, "_items", "_p", "_s_text", "_s", "_f", "_b", "_c")
    )


def parse_labels(df: DataFrame, raw_col: str, max_benefits: int | None = None) -> DataFrame:
    """Adds status (ok or parse_error), error and the label columns of one response per row."""
    block = json_object(F.col(raw_col))
    found = F.coalesce(block != "", F.lit(False))
    problem = F.when(~found, NO_JSON).when(F.col("_v").isNull(), BAD_JSON)
    return (
        check_items(df.withColumn("_v", F.when(found, F.try_parse_json(block))), "_v", problem, max_benefits)
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("parse_error"))
        .select(*df.columns, "status", "error", *LABELS)
    )


# --- packs -------------------------------------------------------------------------------
def parse_packs(responses: DataFrame, max_benefits: int | None = None) -> DataFrame:
    """One ledger row per complaint that was asked about, from responses that cover several.

    `responses` has pack_id, model, prompt_version, mode, ids, truncated_ids, raw, stop_reason and the
    pack's token counts, which are split evenly; a column seq (the order of the attempts, needed by the ledger) is
    handed on. Labels are matched by the id echoed back; an id that
    is missing, repeated or badly labelled is an error of that row alone. Everything happens inside
    the row of the pack and the rows exploded from it, so nothing is shuffled.
    """
    block = json_object(F.col("raw"))
    found = F.coalesce(block != "", F.lit(False))
    packs = (
        responses.withColumn("_v", F.when(found, F.try_parse_json(block)))
        .withColumn("_results", _field(F.col("_v"), "results"))
        .withColumn("_listed", F.try_variant_get("_results", "$", "array<variant>"))
    )
    pack_error = (
        F.when(~found, NO_JSON)
        .when(F.col("_v").isNull(), BAD_JSON)
        .when(F.col("_results").isNull() | (_kind(F.col("_results")) != "ARRAY"), NO_RESULTS)
    )
    refused = F.col("stop_reason").eqNullSafe("refusal")
    # Asked ids and listed items side by side in order of id: an id's items are next to it, whatever the pack's size.
    entry = lambda i, kind, at: F.struct(i.alias("id"), F.lit(kind).alias("kind"), at.alias("at"))
    asked = F.transform("ids", lambda i, k: entry(i.cast("string"), 1, k))
    item_id = lambda x: F.when(_kind(x) == "OBJECT", F.trim(_text(_field(x, "id"))))
    listed = F.transform(F.coalesce("_listed", F.array().cast("array<variant>")), lambda x, k: entry(item_id(x), 0, k))
    new_id = lambda s: F.array_compact(
        F.transform(s, lambda e, k: F.when((k == 0) | ~e["id"].eqNullSafe(F.get(s, k - 1)["id"]), k))
    )
    by_id = lambda s, at: F.transform(at, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - a))
    entries = F.concat(F.filter(listed, lambda e: e["id"].isNotNull()), asked)
    groups = made_once(F.sort_array(entries), lambda s: made_once(new_id(s), lambda at: by_id(s, at)))
    one_each = (
        packs.withColumn("_pack_error", F.when(~refused, pack_error))
        .withColumn("_asked", F.size("ids"))
        .select("*", F.explode(groups).alias("_same"))
        .withColumn("_found", F.filter("_same", lambda e: e["kind"] == 0))
        .select("*", F.explode(F.filter("_same", lambda e: e["kind"] == 1)).alias("_ask"))
        .withColumn("_id", F.get("ids", F.col("_ask.at")))
    )
    matched = one_each.withColumn("_item", F.get("_listed", F.get("_found", F.lit(0))["at"]))
    no_item = F.when(F.size("_found") == 0, ID_MISSING).when(F.size("_found") > 1, ID_TWICE)
    problem = F.when(refused, F.lit("refusal")).otherwise(F.coalesce("_pack_error", no_item))
    checked = check_items(matched, "_item", problem, max_benefits)
    status = (
        F.when(refused, "refusal")
        .when(F.col("_pack_error").isNotNull() & F.col("stop_reason").eqNullSafe("max_tokens"), "output_cut_off")
        .when(F.col("_pack_error").isNull() & (F.col("error") == ID_MISSING), "missing_in_response")
        .when(F.col("error").isNotNull(), "parse_error")
        .otherwise("ok")
    )
    order = ["seq"] if "seq" in responses.columns else []
    return checked.select(
        *order,
        F.col("_id").cast("bigint").alias("complaint_id"),
        "model",
        "prompt_version",
        "mode",
        "pack_id",
        status.alias("status"),
        F.when(~refused, F.col("error")).alias("error"),
        *[(as_col(c).cast("double") / F.col("_asked")).alias(c) for c in USAGE],
        F.array_contains("truncated_ids", F.col("_id")).alias("narrative_truncated"),
        *LABELS,
    )
