"""Column expressions shared by the operators. All of them stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_95 = 1.96


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def made_once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often `then` uses it, inside other lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


# --- rounding and ratios (adding 0.0 turns a negative zero into a plain one) --------------
def round_up(x: Column, digits: int) -> Column:
    """Round half away from zero on the scaled value, the way SQL engines round doubles."""
    scale = float(10**digits)
    return F.round(x * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def round_even(x: Column, digits: int) -> Column:
    """Round half to even on the scaled value, the way pandas rounds doubles."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double; null when the whole is zero or missing."""
    w = as_col(whole).cast("double")
    return F.try_divide(as_col(part).cast("double"), F.when(~F.isnan(w), w))


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole, unrounded; null when the whole is zero or missing."""
    return share(F.lit(100.0) * as_col(part), whole)


def n_rows() -> Column:
    """Aggregate: rows of the group."""
    return F.count(F.lit(1))


def percent_where(condition: Column, digits: int) -> Column:
    """Aggregate: rounded percent of the group's rows for which the condition holds."""
    return round_up(percent(F.count_if(condition), F.count(F.lit(1))), digits)


# --- calendar ----------------------------------------------------------------------------
def month_start(d: Column | str) -> Column:
    return F.trunc(as_col(d), "MM")


def quarter_label(d: Column | str) -> Column:
    d = as_col(d)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))


def months_from(anchor: Column, month: Column) -> Column:
    """Whole calendar months from the anchor to the month; the anchor's own month is 0."""
    return (F.year(month) - F.year(anchor)) * 12 + (F.month(month) - F.month(anchor))


# --- statistics --------------------------------------------------------------------------
def wilson_bounds(k: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval (low, high) clamped to [0, 1]; NaN when n is not positive."""
    k, n = k.cast("double"), n.cast("double")
    z2 = z * z
    p = F.try_divide(k, n)
    spread = F.lit(1.0) + F.try_divide(F.lit(z2), n)
    mid = (p + F.try_divide(F.lit(z2), n * 2.0)) / spread
    arm = F.lit(z) * F.sqrt(
        F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(F.lit(z2), n * n * 4.0)
    ) / spread
    nan = F.lit(float("nan"))
    low = F.when(n > 0, F.greatest(F.lit(0.0), mid - arm)).otherwise(nan)
    high = F.when(n > 0, F.least(F.lit(1.0), mid + arm)).otherwise(nan)
    return low, high


def kish_size(weight: Column | str) -> Column:
    """Aggregate: (sum w)^2 / sum w^2, the number of equal-weight rows; 0 for no rows."""
    w = as_col(weight).cast("double")
    return F.coalesce(F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w)), F.lit(0.0))


def share_change_variance(*cells: tuple[Column, Column]) -> Column:
    """Sum over the (k, n) cells of p(1-p)/n: the sampling variance of a difference of shares."""
    def term(k: Column, n: Column) -> Column:
        p = share(k, n)
        return F.try_divide(p * (F.lit(1.0) - p), n.cast("double"))

    return reduce(lambda a, b: a + b, [term(k, n) for k, n in cells])


# --- groups, draws, text -----------------------------------------------------------------
def lookup(key: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Exact-match map over a short fixed dict; null (or the default) for other keys."""
    if not mapping:
        return F.lit(None).cast("string")
    chain = reduce(lambda acc, kv: acc.when(key == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F)
    return chain if default is None else chain.otherwise(default)


def focus_group(issuer: Column | str, focus: str, other: str) -> Column:
    """The focus entity's own name, or one label for everybody else."""
    return F.when(as_col(issuer) == F.lit(focus), F.lit(focus)).otherwise(F.lit(other))


def draw_key(row_id: Column | str, seed: int | str) -> Column:
    """Seeded pseudo-random sort key of a row. Same id and seed, same key, on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(row_id).cast("string")))


def ascii_regex(pattern: str) -> str:
    r"""SQL-dialect pattern: case-blind, and ``\b`` and ``\s`` know ASCII only."""
    word = "[0-9A-Za-z_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return "(?iu)" + pattern.replace(r"\b", edge).replace(r"\s", r"[\t\n\f\r ]")


def unicode_regex(pattern: str) -> str:
    r"""Text-dialect pattern: case-blind, and ``\b`` and ``\s`` know every script."""
    return "(?iuU)" + pattern


# Letters outside ASCII that case-blind matching takes for i, k and s.
ASCII_LOOKALIKES = ["\u0131", "\u0130", "\u212a", "\u017f"]


def with_search_columns(df: DataFrame, text: str) -> DataFrame:
    """Adds what `matches` needs, once per row: the lower-case text and whether it has a lookalike."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ASCII_LOOKALIKES])
    return df.withColumns({"_low": F.lower(text), "_odd": odd})


def known_fragments(
    name: str, pattern: str, patterns: dict[str, str], fragments: dict[str, list[str]]
) -> Sequence[str]:
    """The plain fragments of a pattern: those listed for the pattern of that name, none for any other pattern."""
    return fragments.get(name, ()) if patterns.get(name) == pattern else ()


def matches(text: str, regex: str, fragments: Sequence[str]) -> Column:
    """text.rlike(regex), with the regex run only on text that holds a fragment of it.

    A plain search costs a small part of a case-blind regex, and most texts hold no fragment of most
    patterns. Text with a letter that lower case does not bring to ASCII but case-blind matching does
    goes to the regex as well, so the result is always the same. Without fragments the regex always runs.
    """
    if not fragments:
        return F.col(text).rlike(regex)
    could = reduce(lambda a, b: a | b, [F.contains("_low", F.lit(f)) for f in fragments], F.col("_odd"))
    return could & F.col(text).rlike(regex)


def one_spaced(text: Column) -> Column:
    """Runs of any white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
