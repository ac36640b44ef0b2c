"""Personal data by fixed patterns and by bootstrapped contexts. Built-in functions only.

Spans of four kinds are found by pattern. They are the seeds of the bootstrapping: the word before a seed,
with the seed's kind, is a lexical pattern, and a pattern and the tokens it introduces form a bipartite graph.
Patterns and tokens are scored from each other in rounds: a token is credible as far as the patterns it follows
are, a pattern as far as the tokens it introduces are. Patterns above a threshold then mark every token of
identifier form they introduce, seen as a seed or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import stored, text_of

# The patterns as agreed. Those below match the same spans in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A match can only start where its run of characters does or where the match before it ended, and a run
# taken is never given back, so no start is tried twice and no group recurses.
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
# A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
STEP = 256  # matches whose places are summed up at once

# A token of identifier form: a run without blanks, quotes, commas and brackets that has a digit and 6 to 128
# characters. Where a token could start, a span of the patterns goes first.
_RUN = r"\s\"',;()<>"
TOKEN = rf"(?<![^{_RUN}])(?=[^{_RUN}0-9]*+[0-9])[^{_RUN}]++"
MENTION = "|".join(f"(?:{_FAST[k]})" for k in ("email", "phone", "ip", "card")) + f"|(?:{TOKEN})"
LENGTHS = (6, 128)
CUE = rf"([^{_RUN}]+)[{_RUN}]*\z"  # the word before a token
LOOK_BACK = 200  # characters in which that word must lie

ROUNDS = 3
MIN_SUPPORT = 5  # different tokens a pattern must introduce
MIN_SCORE = 0.5


def _places(pieces: Column, found: Column) -> Column:
    """(start, end, value) of every match, from the texts between the matches and the matches.

    Places are summed up a block at a time, so a text with very many matches is not copied for each.
    """
    pairs = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    full = F.filter(pairs, lambda p: p["value"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def one(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        span = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(full, k * STEP + 1, STEP), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))[0]

    steps = F.sequence(F.lit(0), F.floor((F.size(full) - 1) / STEP).cast("int"))
    return F.when(F.size(full) > 0, F.aggregate(steps, begin, block, lambda acc: acc["out"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.transform(F.split(back, ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0),
        lambda acc, d: acc + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(F.substring(digits, 1, 19))
    return F.length(digits).between(9, 15)


def _checked(places: str, kind: str, number: int) -> Column:
    """The valid ones among the matches of a kind, with its number."""
    ok = F.filter(places, lambda s: _valid(kind, s["value"]))
    return F.transform(
        ok,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
        ),
    )


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds an array of (start, kind number, end, value) of the pattern spans, by start, then kind.

    Matches are leftmost and do not overlap within a kind; places are code points, the end exclusive. An
    address needs parts of at most 255, a card number 12 to 19 digits that pass the Luhn check, a phone number 9
    to 15 digits; a match that fails is dropped and not tried again. A null text has none.
    """
    body = text_of(text)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    step = docs
    for kind in KINDS:
        has = F.contains(body, F.lit("@")) if kind == "email" else F.rlike(body, F.lit(_NEEDS[kind]))
        step = step.withColumn(f"_found_{kind}", F.when(has, F.regexp_extract_all(body, F.lit(_FAST[kind]), F.lit(0))))
    for kind in KINDS:
        some = F.size(f"_found_{kind}") > 0
        step = step.withColumn(f"_pieces_{kind}", F.when(some, F.split(body, _FAST[kind], -1)))
    spans = []
    for n, kind in enumerate(KINDS):
        step = step.withColumn(f"_at_{kind}", F.when(F.col(f"_pieces_{kind}").isNotNull(), _places(F.col(f"_pieces_{kind}"), F.col(f"_found_{kind}"))))
        spans.append(F.coalesce(_checked(f"_at_{kind}", kind, n), empty))
    step = step.withColumn(out, F.sort_array(F.concat(*spans)))
    return step.drop(*[f"_{p}_{k}" for p in ("found", "pieces", "at") for k in KINDS])


def mentions(docs: DataFrame, text: str = "text", out: str = "mentions") -> DataFrame:
    """Adds an array of every token of identifier form: (start, end, token, cue, seed).

    cue is the word before it in lower case, null without one; seed tells whether the token is a pattern span.
    """
    body = text_of(text)
    step = docs.withColumn("_tokens", F.when(F.rlike(body, F.lit("[0-9@]")), F.regexp_extract_all(body, F.lit(MENTION), F.lit(0))))
    step = step.withColumn("_parts", F.when(F.size("_tokens") > 0, F.split(body, MENTION, -1)))
    step = step.withColumn("_where", F.when(F.col("_parts").isNotNull(), _places(F.col("_parts"), F.col("_tokens"))))

    def seed(value: Column) -> Column:
        each = [F.rlike(value, F.lit(rf"\A(?:{PATTERNS[k]})\z")) & _valid(k, value) for k in ("email", "ip", "phone")]
        card = F.rlike(value, F.lit(rf"\A(?:{_FAST['card']})\z")) & _valid("card", value)
        return each[0] | each[1] | each[2] | card

    made = F.transform(
        "_where",
        lambda t, n: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            t["value"].alias("token"),
            F.nullif(F.lower(F.regexp_extract(F.right(F.get("_parts", n), F.lit(LOOK_BACK)), CUE, 1)), F.lit("")).alias("cue"),
            F.when(F.length(t["value"]) <= LENGTHS[1], seed(t["value"])).otherwise(False).alias("seed"),
        ),
    )
    kept = F.filter(made, lambda m: F.length(m["token"]).between(*LENGTHS))
    return step.withColumn(out, kept).drop("_tokens", "_parts", "_where")


def credible_patterns(
    found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE
) -> DataFrame:
    """(cue, score, support) of the patterns worth trusting, from rows of (token, cue, seed).

    Edges are the distinct pairs of cue and token. A seed has score 1, other tokens the mean score of their cues
    (0 at first); a cue the mean score of its tokens, with one more of score 0 for caution. Rows without a cue
    are left out. Each round is two grouped sums with map-side partial sums.
    """
    edges = found.filter("cue IS NOT NULL AND token IS NOT NULL").groupBy("cue", "token").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pattern-edges")
    scored = edges.withColumn("t", F.col("seed").cast("double"))
    cues = None
    for n in range(rounds):
        cues = scored.groupBy("cue").agg(
            (F.sum("t") / (F.count(F.lit(1)) + 1)).alias("score"), F.count(F.lit(1)).alias("support"), F.max("seed").alias("seeded")
        )
        if n + 1 < rounds:
            open_edges = edges.filter(~F.col("seed")).join(cues.select("cue", "score"), "cue")
            tokens = open_edges.groupBy("token").agg(F.avg("score").alias("t"))
            scored = stored(
                edges.filter("seed").withColumn("t", F.lit(1.0)).unionByName(edges.filter(~F.col("seed")).join(tokens, "token")),
                "pattern-scores",
            )
    return cues.filter((F.col("support") >= min_support) & (F.col("score") >= min_score) & F.col("seeded")).drop("seeded")


def find_personal_data(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """row_id and spans of every row: an array of (start, kind, end) by start, then kind, and `base`, those found
    by pattern.

    kind is email, ip, card or phone, or id for what a credible pattern discovered. Null and empty texts have no
    spans. Rows are told apart by id and text, so repeated rows get equal results and a null id is fine; other
    columns are not read. Very long texts are read whole.
    """
    rows = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(row_id, text).alias("_key"))
    read = mentions(base_spans(rows, "_text"), "_text").select("_id", "_key", "base", "mentions")
    read = stored(read, "mentions")
    found = read.filter(F.size("mentions") > 0).select("_key", F.inline("mentions"))
    patterns = stored(credible_patterns(found.select("token", "cue", "seed"), **settings), "patterns")
    new = (
        found.filter("NOT seed AND cue IS NOT NULL")
        .join(patterns.select("cue"), "cue", "left_semi")
        .groupBy("_key")
        .agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("new"))
    )
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    light = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = F.sort_array(F.concat(light, F.coalesce("new", none)))
    named = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"))
    )
    return read.select("_id", "_key", "base").join(new, "_key", "left").select(
        F.col("_id").alias(row_id), named(every).alias("spans"), named(light).alias("base")
    )


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
