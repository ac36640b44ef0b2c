"""Quality rules: a threshold table compiled into one projection. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import BLANKS, text_of, word_array

# Patterns of the characters counted and of what parts plain words, and the commonest
# function words of the four languages.
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?]"
BETWEEN_PLAIN_WORDS = r"[\x20\x09-\x0D.,;:!?\"'()]+"
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at from this or an are not "
    "de la le les des et un une en que qui dans pour par sur du au il ne pas "
    "el los las y se del su con no una es lo "
    "der die das und zu den von mit sich auf für ist im dem nicht ein eine"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if `least <= metric <= most`; a null bound is none. Null metrics pass."""

    metric: str
    least: float | None = None
    most: float | None = None


# Shorter texts have no stop-word ratio: a single sentence may well hold no function word.
STOP_WORDS_FROM = 25

# The production table. Ratios are per word, but duplicate lines per line with a word.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _covered(words: Column, n: int) -> tuple[Column, Column]:
    """Hashes of all n-word windows, and the sorted (hash, position) pairs of a text that repeats one."""
    count = F.size(words)
    windows = F.when(
        count >= n,
        F.transform(F.sequence(F.lit(1), F.greatest(count - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(
        F.size("_windows") > F.size(F.array_distinct("_windows")),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    return windows, pairs


def _repeat_words(n: int) -> Column:
    """Words inside windows that occur twice or more, from the columns `_pairs`."""
    hash_at = lambda j: F.get(F.col("_pairs"), j)["h"]
    twice = F.filter(
        F.col("_pairs"),
        lambda p, j: F.coalesce(p["h"] == hash_at(j - 1), F.lit(False)) | F.coalesce(p["h"] == hash_at(j + 1), F.lit(False)),
    )
    places = F.sort_array(F.transform(twice, lambda p: p["i"]))
    start = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("bigint").alias("n"))
    total = F.aggregate(
        places,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(n), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.col("_pairs").isNull(), F.lit(0).cast("bigint")).otherwise(total)


def measured(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds the counts and ratios of every whole text.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, and the ratios
    the rules use. A null text counts as empty; ratios without words or lines are null. Windows are
    compared by 64-bit hashes. Texts under 25 words have no stop-word ratio. The input's own columns of these names are replaced, others pass through;
    rows stay as they are, repeated ones too.
    """
    body = text_of(text)
    with_words = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    plain = F.split(F.lower(body), BETWEEN_PLAIN_WORDS)
    step = docs.withColumns({"_words": word_array(body), "_lines": with_words, "_plain": plain})
    windows, pairs = _covered(F.col("_words"), window)
    step = step.withColumns({"_windows": windows}).withColumns({"_pairs": pairs})
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(window),
        "n_shouts": F.regexp_count(body, F.lit(SHOUTS)),
        "n_stop_words": F.size(F.filter("_plain", lambda w: w.isin(*STOP_WORDS))),
    }
    # One row of counts, made by a generator: a filter on them is then not moved below and worked out twice.
    own = F.inline(F.array(F.struct(*[c.cast("bigint").alias(n) for n, c in counts.items()])))
    step = step.select(*[c for c in docs.columns if c not in counts], own)
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return step.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "shout_ratio": per("n_shouts", "n_words"),
            "stop_word_ratio": F.when(F.col("n_words") >= STOP_WORDS_FROM, per("n_stop_words", "n_words")),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The rules that a measured row breaks, as an array of metric names."""
    broken = []
    for r in rules:
        low = F.col(r.metric) < r.least if r.least is not None else F.lit(False)
        high = F.col(r.metric) > r.most if r.most is not None else F.lit(False)
        broken.append(F.when(low | high, F.lit(r.metric)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judged(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`measured`, with the broken rules and the verdict `kept`.

    A row is kept if it is not base_failed and breaks no rule. Empty and null texts are not kept.
    """
    rows = measured(docs, text).withColumn("broken_rules", compiled(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
