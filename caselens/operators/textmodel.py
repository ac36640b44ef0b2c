"""Theme model over whole texts: TF-IDF of words and word pairs, multinomial logistic regression.

A fitted model is a pyspark.ml PipelineModel, so it is saved and loaded as one, and scoring is a map over the
corpus: terms by SQL expressions, counts by a vectoriser that holds the vocabulary, dampened counts, idf and
length by vector stages, then the regression. The vocabulary is numbered by a range sort, without a window over
all terms, so it needs no limit.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions import rules
from caselens.functions.exprs import lookup, made_once, percent, round_even, share
from caselens.functions.frames import keep, numbered, shuffled_rank, small_or_plain
from caselens.operators.keywords import with_keyword_themes
from caselens.operators.sampling import seeds_of

MIN_DF = 3
MAX_FEATURES = 150_000
INVERSE_PENALTY = 8.0
MAX_ITER = 2000
TOLERANCE = 1e-5
UNSURE_BELOW = 0.5
ENTRIES_PER_TASK = 2_000_000  # vector entries a task of the regression holds, about, while there are cores for more tasks
MOST_ENTRIES_PER_TASK = 16_000_000
NUMBERS_PER_FIT = 30  # numbers of each class and term that a running fit has on the driver: ten steps back, twice, and more
FIT_BYTES = 256 << 20  # of the driver for all fits that run at once


# --- terms -------------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters of all of Unicode that decompose: those that become one character, that character, the others.

    Marks are left out of what a character becomes. Hangul syllables stay whole.
    """
    one, other = {}, {}
    for code in [*range(0xA0, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x30000)]:
        c = chr(code)
        plain = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if plain != c and not unicodedata.combining(c):
            (one if len(plain) == 1 else other)[c] = plain
    return "".join(one), "".join(one.values()), other


def without_accents(text: Column) -> Column:
    """Text without accents in any script, whether they are part of a letter or marks after it."""
    letters, plain, longer = _plain_letters()
    table = F.str_to_map(F.lit("\n".join(f"{c}\t{d}" for c, d in longer.items())), F.lit("\n"), F.lit("\t"))
    spell = lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(table, c), c)).otherwise(c)
    spelled = F.array_join(F.transform(F.split(text, ""), spell), "")
    has_longer = F.translate(text, "".join(longer), "") != text
    whole = F.when(has_longer, spelled).otherwise(text)
    stripped = F.regexp_replace(F.translate(whole, letters, plain), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), stripped).otherwise(text)


def term_array(text: Column, stop_words: Sequence[str]) -> Column:
    """Words and pairs of neighbouring words of a text, each as often as it occurs; none for a null text.

    Words are runs of two or more word characters, lower case, without accents and stop words.
    """
    plain = without_accents(F.lower(text))
    words = F.filter(F.regexp_extract_all(plain, F.lit(r"(?U)\w\w+"), F.lit(0)), lambda w: ~w.isin(*stop_words))
    pairs = lambda w: F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
        F.slice(w, 2, F.greatest(F.size(w), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.coalesce(made_once(words, lambda w: F.concat(w, pairs(w))), F.array().cast("array<string>"))


class Terms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: text to its array of terms."""

    stopWords: Param[list[str]] = Param(Params._dummy(), "stopWords", "words left out", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, stopWords: list[str] | None = None):
        super().__init__()
        self._setDefault(stopWords=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = term_array(F.col(self.getInputCol()), self.getOrDefault("stopWords"))
        return dataset.withColumn(self.getOutputCol(), found)


_VECTOR = "struct<type:int,size:int,indices:array<int>,values:array<double>>"


class Dampened(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: a sparse vector of counts to 1 + ln(count) of each entry."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # SQL reaches the entries of a vector, and makes one, by way of its JSON form; no Python is involved.
        made = T.StructType([T.StructField("v", VectorUDT())])
        entries = F.from_json(F.to_json(F.struct(F.col(self.getInputCol()).alias("v"))), f"v {_VECTOR}")["v"]
        dampened = lambda v: F.struct(
            v["type"].alias("type"),
            v["size"].alias("size"),
            v["indices"].alias("indices"),
            F.transform(v["values"], lambda x: 1.0 + F.log(x)).alias("values"),
        )
        vector = F.struct(made_once(entries, dampened).alias("v"))
        return dataset.withColumn(self.getOutputCol(), F.from_json(F.to_json(vector), made)["v"])


def idf_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed idf, shifted by one so that a term of every document still counts."""
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


class ShiftedIdf(Estimator, HasInputCol, HasOutputCol):
    """Learns the idf of each place of a vector; places in fewer than minDF rows weigh nothing.

    Beyond `maxFeatures` the places with the largest totals of `countCol` are kept, of equal ones those whose
    `numbers` come first.
    """

    def __init__(self, inputCol: str, outputCol: str, countCol: str, minDF: int, maxFeatures: int | None, numbers: np.ndarray):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.count_col, self.min_df, self.max_features, self.numbers = countCol, minDF, maxFeatures, numbers

    def copy(self, extra=None):
        return ShiftedIdf(self.getInputCol(), self.getOutputCol(), self.count_col, self.min_df, self.max_features, self.numbers)

    def _fit(self, dataset: DataFrame) -> Model:
        found = Summarizer.metrics("numNonZeros", "count", "sum").summary(F.col(self.count_col))
        row = dataset.select(found.alias("s")).select("s.numNonZeros", "s.count", "s.sum").first()
        df, n, total = row["numNonZeros"].toArray(), row["count"], row["sum"].toArray()
        used = df >= self.min_df
        if self.max_features is not None and used.sum() > self.max_features:
            order = np.lexsort((self.numbers, np.where(used, -total, 1)))
            used[order[self.max_features :]] = False
        weights = np.where(used, idf_weights(df, n), 0.0)
        return ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class BalancedRegression(Estimator):
    """Multinomial logistic regression in which all classes weigh the same however many rows they have."""

    def __init__(self, tolerance: float = TOLERANCE):
        super().__init__()
        self.tolerance = tolerance

    def copy(self, extra=None):
        return BalancedRegression(self.tolerance)

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        sizes = {r["label"]: r["n"] for r in dataset.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(sizes.values())
        weight = lookup(F.col("label").cast("int").cast("string"), {str(int(k)): str(n / (len(sizes) * v)) for k, v in sizes.items()})
        model = LogisticRegression(
            family="multinomial",
            weightCol="weight",
            regParam=1.0 / (INVERSE_PENALTY * n),
            standardization=False,
            maxIter=MAX_ITER,
            tol=self.tolerance,
        ).fit(dataset.withColumn("weight", weight.cast("double")))
        # A fit leaves the state of hundreds of jobs: buffers and broadcasts go when the driver's JVM collects them.
        dataset.sparkSession.sparkContext._jvm.System.gc()
        return model


# --- vocabulary and vectors --------------------------------------------------------------
def _stop(stop_words: Sequence[str] | None) -> list[str]:
    return list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")


def _term_counts(docs: DataFrame, min_df: int, folds: int = 0) -> DataFrame:
    """(term, df, total) of the terms in at least `min_df` rows of `terms`; with `folds`, also df0, total0 ... of each `fold`."""
    # All terms of a row, and once more the distinct ones: their counts are total and df.
    listed = docs.select(
        *(["fold"] if folds else []),
        F.explode_outer(
            F.array(F.struct(F.col("terms"), F.lit(0).alias("once")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(1).alias("once")))
        ).alias("l"),
    )
    # An inner explode would work the terms out a second time, to filter out empty arrays.
    found = listed.select(*(["fold"] if folds else []), F.col("l.once").alias("once"), F.explode_outer("l.terms").alias("term"))
    inside = lambda k, n: F.sum(F.when(F.col("fold") == k, n).otherwise(0))
    once, again = F.col("once"), 1 - F.col("once")
    per_fold = [c for k in range(folds) for c in (inside(k, once).alias(f"df{k}"), inside(k, again).alias(f"total{k}"))]
    counted = found.filter("term IS NOT NULL").groupBy("term").agg(F.sum(once).alias("df"), F.sum(again).alias("total"), *per_fold)
    # The range sort reads its input twice: what it reads is written first, without the rare terms.
    return keep(counted.filter(F.col("df") >= min_df), "term-counts")


def vocabulary(docs: DataFrame, min_df: int = MIN_DF, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, df, total, index) of the terms in at least `min_df` rows of `terms`, numbered by falling total.

    Terms are grouped by their canonical form, which `terms` holds. Numbers come from a range sort and the sizes of
    the ranges, so any number of terms will do; `max_features`, if given, keeps the first ones.
    """
    out = numbered(_term_counts(docs, min_df), [F.desc("total"), F.asc("term")], "index", "vocabulary")
    return out if max_features is None else out.filter(F.col("index") < max_features)


def folds_vocabulary(docs: DataFrame, folds: int, min_df: int = MIN_DF, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, df, total, index) of the terms that the vocabulary of all rows, or of all but one fold's, holds.

    The numbers are those of all rows. `fold` tells a row's fold, from 0. Terms that no model has in use stay off the driver.
    """
    if max_features is None:
        return vocabulary(docs, min_df, None)
    table = keep(numbered(_term_counts(docs, min_df, folds), [F.desc("total"), F.asc("term")], "index", "vocabulary"), "vocabulary")
    used = table.filter(F.col("index") < max_features).select("index")
    for k in range(folds):
        others = table.filter(F.col("df") - F.col(f"df{k}") >= min_df).select("index", (F.col("total") - F.col(f"total{k}")).alias("rest"))
        first = numbered(others, [F.desc("rest"), F.asc("index")], "place", "fold-vocabulary")
        used = used.unionByName(first.filter(F.col("place") < max_features).select("index"))
    return table.join(used.distinct(), "index", "left_semi").select("term", "df", "total", "index")


def ordered_terms(table: DataFrame) -> tuple[list[str], np.ndarray]:
    """The terms in order and their row counts: what a model holds, on the driver as well."""
    rows = sorted(table.select("index", "term", "df").collect())
    return [r["term"] for r in rows], np.array([r["df"] for r in rows], dtype=float)


def vectoriser(table: DataFrame) -> CountVectorizerModel:
    """A vectoriser with the terms of a vocabulary, in an order of its own.

    It is fitted on the table, since a list of terms would go to the JVM one by one.
    """
    # A vectoriser needs one term at least; no text has the empty one.
    listed = table.select(F.array("term").alias("terms")).unionByName(table.sparkSession.sql("SELECT array('') AS terms"))
    return CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=(1 << 31) - 1, minDF=1.0).fit(listed)


def _last_stages(idf: Transformer | Estimator, regression: Transformer | Estimator) -> list:
    return [idf, Normalizer(p=2.0, inputCol="weighted", outputCol="features"), regression]


def vocabulary_numbers(table: DataFrame, counter: CountVectorizerModel) -> tuple[np.ndarray, int]:
    """The number that each place of a vectoriser has in a vocabulary (places of no term come last), and the sum of df."""
    rows = table.select("term", "index", "df").toArrow()
    at = pc.index_in(pa.array(counter.vocabulary, pa.string()), value_set=rows["term"].combine_chunks())
    index = rows["index"].combine_chunks()
    numbers = pc.fill_null(index.take(at), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return numbers, pc.sum(rows["df"]).as_py() or 0


def regression_tasks(entries: int, cores: int) -> int:
    """The tasks that a regression over so many vector entries has.

    Every task sends back one number per class and term: beyond two for each core, tasks get larger instead of more.
    """
    return max(1, min(math.ceil(entries / ENTRIES_PER_TASK), max(2 * cores, math.ceil(entries / MOST_ENTRIES_PER_TASK))))


def fits_at_once(folds: int, classes: int, terms: int) -> int:
    """The fits that may run at the same time: each has its steps back on the driver."""
    return max(1, min(folds, FIT_BYTES // (8 * NUMBERS_PER_FIT * max(1, classes * terms))))


def counted_frame(
    train: DataFrame, text: str, label: str, classes: Sequence[str], stop_words: Sequence[str] | None, min_df: int,
    max_features: int | None, *also: str, folds: int = 0,
) -> tuple[DataFrame, CountVectorizerModel, np.ndarray]:
    """The training rows vectorised once (label as a number, counts, dampened counts).

    With them the vectoriser and the number that each of its places has in the vocabulary. With `folds` it holds what
    the models without each `fold` have in use, too.
    """
    stage = Terms(inputCol=text, outputCol="terms", stopWords=_stop(stop_words))
    place = lookup(F.col(label), {c: str(i) for i, c in enumerate(classes)}).cast("double")
    # The terms are worked out twice, for the vocabulary and for the counts: stored, they take several times the texts.
    docs = stage.transform(train.select(text, place.alias("label"), *also)).drop(text)
    found = folds_vocabulary(docs, folds, min_df, max_features) if folds else vocabulary(docs, min_df, max_features)
    table = keep(found, "model-vocabulary")
    counter = vectoriser(table)
    numbers, entries = vocabulary_numbers(table, counter)
    frame = keep(Dampened(inputCol="counts", outputCol="dampened").transform(counter.transform(docs)).drop("terms"), "vectors")
    return frame.repartition(regression_tasks(entries, train.sparkSession.sparkContext.defaultParallelism)), counter, numbers


def _classes(train: DataFrame, label: str) -> dict[str, int]:
    """Rows of each class of a fixed label set."""
    rows = train.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["label"]: r["n"] for r in sorted(rows, key=lambda r: r["label"])}


def _whole_model(text: str, counter: CountVectorizerModel, fitted: PipelineModel, classes: Sequence[str], stop_words: Sequence[str] | None) -> PipelineModel:
    return PipelineModel(
        [
            Terms(inputCol=text, outputCol="terms", stopWords=_stop(stop_words)),
            counter,
            Dampened(inputCol="counts", outputCol="dampened"),
            *fitted.stages,
            IndexToString(inputCol="prediction", outputCol="primary_theme", labels=list(classes)),
        ]
    )


def fit_theme_model(
    train: DataFrame,
    row_id: str,
    text: str,
    label: str,
    stop_words: Sequence[str] | None = None,
    min_df: int = MIN_DF,
    max_features: int | None = MAX_FEATURES,
    tolerance: float = TOLERANCE,
) -> PipelineModel:
    """Fits on rows with one label each; classes weigh the same however many rows they have.

    Rows without a label are left out. The model reads the column `text`; `.write().save(path)` and
    `PipelineModel.load(path)` keep it.
    """
    train = train.filter(F.col(label).isNotNull())
    classes = list(_classes(train, label))
    frame, counter, numbers = counted_frame(train, text, label, classes, stop_words, min_df, max_features)
    idf = ShiftedIdf("dampened", "weighted", "counts", min_df, max_features, numbers)
    fitted = Pipeline(stages=_last_stages(idf, BalancedRegression(tolerance))).fit(frame)
    return _whole_model(text, counter, fitted, classes, stop_words)


def given_theme_model(
    spark,
    text: str,
    classes: Sequence[str],
    terms: Sequence[str],
    idf: Sequence[float],
    coefficients: np.ndarray,
    intercepts: Sequence[float],
    stop_words: Sequence[str] | None = None,
) -> PipelineModel:
    """The model of given numbers: coefficients are classes x terms."""
    # Bounds that meet leave the regression no choice. A row per class shows it every class and term.
    rows = [(float(k), Vectors.dense([float(k)] * len(terms))) for k in range(len(classes))]
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    held = DenseMatrix(len(classes), len(terms), np.asarray(coefficients, dtype=float).ravel().tolist(), True)
    at = Vectors.dense(list(intercepts))
    regression = LogisticRegression(
        family="multinomial", standardization=False, maxIter=1, lowerBoundsOnCoefficients=held, upperBoundsOnCoefficients=held,
        lowerBoundsOnIntercepts=at, upperBoundsOnIntercepts=at,
    ).fit(spark.createDataFrame(rows, schema))
    counter = CountVectorizerModel.from_vocabulary(list(terms), inputCol="terms", outputCol="counts")
    product = ElementwiseProduct(scalingVec=Vectors.dense(list(idf)), inputCol="dampened", outputCol="weighted")
    return _whole_model(text, counter, PipelineModel(_last_stages(product, regression)), classes, stop_words)


# --- scoring -----------------------------------------------------------------------------
def predict_themes(model: PipelineModel, corpus: DataFrame, text: str = "narrative") -> DataFrame:
    """Every other column of the corpus with primary_theme and confidence for each row, in one map over it.

    Each row is scored by itself: equal rows stay separate, null and empty texts get what the intercepts say.
    """
    reads = model.stages[0].getInputCol()
    others = [c for c in corpus.columns if c != text]
    # The stages' own columns must not meet the corpus's: those travel in one struct.
    row = corpus.select(F.struct(*others).alias("_row") if others else F.lit(True).alias("_row"), F.col(text).alias(reads))
    scored = model.transform(row)
    best = F.array_max(vector_to_array("probability"))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in others]
    return scored.select(*kept, "primary_theme", best.alias("confidence"))


def theme_model(
    corpus: DataFrame,
    labels: DataFrame | None = None,
    min_labels: int = rules.MIN_LABELS_TO_DISTIL,
    seed_cap: int = rules.SEED_CAP_PER_THEME,
    stop_words: Sequence[str] | None = None,
    row_id: str = "complaint_id",
    text: str = "narrative",
    mode: str | None = None,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """A theme and its confidence for every row of the corpus, and which kind of model gave it.

    `mode` is "labels" (train on them) or "keywords" (train on rows that match exactly one keyword rule). Left out,
    it is "labels" when there are at least `min_labels` of them. In keyword mode a row that no rule matches and that
    the model is unsure of becomes "other". The rules run over the corpus once, for the seeds and for this.
    """
    if mode is None:
        mode = "labels" if labels is not None and labels.count() >= min_labels else "keywords"
    if mode == "labels":
        wanted = labels.select(row_id, F.col("primary_theme").alias("_theme"))
        train = corpus.select(row_id, text).join(small_or_plain(wanted), row_id)
        model = fit_theme_model(train, row_id, text, "_theme", stop_words, max_features=max_features)
        return predict_themes(model, corpus, text).withColumn("label_source", F.lit(rules.FROM_DISTILLED_MODEL))
    if mode != "keywords":
        raise ValueError(f"unknown mode {mode!r}")

    tagged = keep(with_keyword_themes(corpus, text, "_themes"), "tagged")
    seeds = seeds_of(tagged, "_themes", seed_cap, row_id=row_id)
    model = fit_theme_model(seeds, row_id, text, "theme", stop_words, max_features=max_features)
    scored = predict_themes(model, tagged, text)
    unsure = (F.size("_themes") == 0) & (F.col("confidence") < UNSURE_BELOW)
    return (
        scored.withColumn("primary_theme", F.when(unsure, "other").otherwise(F.col("primary_theme")))
        .drop("_themes")
        .withColumn("label_source", F.lit(rules.FROM_KEYWORD_MODEL))
    )


# --- quality -----------------------------------------------------------------------------
def stratified_folds(
    train: DataFrame, row_id: str, label: str, folds: int = 5, min_class: int = 5, seed: int = rules.MODEL_SEED
) -> DataFrame:
    """(row_id, label, fold): rows of each class dealt in seeded random order, so folds hold like shares of it.

    A class with fewer than `min_class` rows is not split: its rows have a null fold. Rows without a label are left out.
    """
    named = train.select(F.col(row_id).alias("row_id"), F.col(label).alias("label")).filter("label IS NOT NULL")
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = shuffled_rank(named, "row_id", seed, by=["label"], out="_place").join(sizes, "label")
    fold = F.when(F.col("_rows") >= min_class, ((F.col("_place") - 1) % folds).cast("int"))
    return ranked.select("row_id", "label", fold.alias("fold"))


def cross_validated(
    train: DataFrame,
    row_id: str,
    text: str,
    label: str,
    folds: int = 5,
    min_class: int = 5,
    seed: int = rules.MODEL_SEED,
    stop_words: Sequence[str] | None = None,
    min_df: int = MIN_DF,
    max_features: int | None = MAX_FEATURES,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, PipelineModel]:
    """(row_id, label, primary_theme) with the theme each row gets from the folds it is not in, and the model of all.

    The rows are vectorised once; idf, the terms in use and the regression are fitted anew without each fold. Rows of
    classes too small to split take no part and have a null theme. Row ids must be unique.
    """
    dealt = stratified_folds(train, row_id, label, folds, min_class, seed)
    named = train.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).join(dealt, "row_id")
    named = keep(named, "dealt")
    sizes = _classes(named, "label")
    classes = [c for c, n in sizes.items() if n >= min_class]
    split = named.filter("fold IS NOT NULL")
    frame, counter, numbers = counted_frame(split, "text", "label", classes, stop_words, min_df, max_features, "row_id", "fold", folds=folds)
    idf = ShiftedIdf("dampened", "weighted", "counts", min_df, max_features, numbers)
    found = CrossValidator(
        estimator=Pipeline(stages=_last_stages(idf, BalancedRegression(tolerance))),
        estimatorParamMaps=[{}],
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=fits_at_once(folds, len(classes), len(numbers)),
        collectSubModels=True,
    ).fit(frame)
    names = IndexToString(inputCol="prediction", outputCol="primary_theme", labels=classes)
    label_names = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("label") + 1).cast("int"))
    parts = [
        names.transform(found.subModels[k][0].transform(frame.filter(F.col("fold") == k))).select(
            "row_id", label_names.alias("label"), "primary_theme"
        )
        for k in range(folds)
    ]
    rest = named.filter("fold IS NULL").select("row_id", "label", F.lit(None).cast("string").alias("primary_theme"))
    predicted = rest
    for part in parts:
        predicted = predicted.unionByName(part)
    return keep(predicted, "predicted"), _whole_model(text, counter, found.bestModel, classes, stop_words)


def fold_scores(predicted: DataFrame) -> DataFrame:
    """(metric, theme, value, rows): agreement, macro F1 and F1 per class of (label, primary_theme) rows.

    Rows with a null primary_theme belong to classes that were not split: such a class is listed with its rows and a
    null F1, and does not count for the rest.
    """
    pairs = predicted.groupBy("label", "primary_theme").agg(F.count(F.lit(1)).alias("n"))
    same = F.when(F.col("label") == F.col("primary_theme"), F.col("n")).otherwise(0)
    tested = F.col("primary_theme").isNotNull()
    sides = F.array(
        F.struct(F.col("label").alias("theme"), F.lit(True).alias("truth"), tested.alias("tested")),
        F.struct(F.col("primary_theme").alias("theme"), F.lit(False).alias("truth"), tested.alias("tested")),
    )
    per_side = pairs.select("n", same.alias("same"), F.inline(sides)).filter("theme IS NOT NULL")
    scores = per_side.groupBy("theme").agg(
        # F1 = 2 * hits / (true rows + predicted rows); `same` and `n` appear once per side.
        F.when(F.bool_or("tested"), share(F.sum("same"), F.sum("n"))).alias("f1"),
        F.sum(F.when(F.col("truth"), F.col("same")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("truth"), F.col("n")).otherwise(0)).alias("rows"),
        F.sum(F.when(F.col("truth") & F.col("tested"), F.col("n")).otherwise(0)).alias("tested_rows"),
    )
    per_class = scores.select(F.lit("f1").alias("metric"), "theme", F.col("f1").alias("value"), "rows")
    overall = scores.agg(
        share(F.sum("hits"), F.sum("tested_rows")).alias("agreement"),
        F.avg("f1").alias("macro_f1"),
        F.sum("tested_rows").alias("rows"),
    )
    listed = F.array(
        F.struct(F.lit("agreement").alias("metric"), F.lit(None).cast("string").alias("theme"), F.col("agreement").alias("value"), "rows"),
        F.struct(F.lit("macro_f1").alias("metric"), F.lit(None).cast("string").alias("theme"), F.col("macro_f1").alias("value"), "rows"),
    )
    return overall.select(F.inline(listed)).unionByName(per_class).withColumn("value", round_even(F.col("value"), 3))


def theme_model_cv(train: DataFrame, row_id: str, text: str, label: str, **settings) -> DataFrame:
    """Stratified cross-validated agreement with the labels, macro F1, and F1 and rows per class."""
    return fold_scores(cross_validated(train, row_id, text, label, **settings)[0])


def theme_model_share(model_labels: DataFrame) -> DataFrame:
    """Share of each predicted theme."""
    counts = model_labels.groupBy("primary_theme").agg(F.count(F.lit(1)).alias("n"))
    total = model_labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("primary_theme", round_even(percent("n", total), 1).alias("share_pct"))


# --- report ------------------------------------------------------------------------------
def _report(key: str, value: Column, theme: Column | None = None) -> list[Column]:
    return [F.lit(key).alias("key"), (theme if theme is not None else F.lit(None)).cast("string").alias("theme"), value.cast("double").alias("value")]


def _shares(scored: DataFrame) -> DataFrame:
    labelled = scored.agg(F.count(F.lit(1)).alias("n")).select(*_report("narratives_labelled", F.col("n")))
    return labelled.unionByName(theme_model_share(scored).select(*_report("theme_share_pct", F.col("share_pct"), F.col("primary_theme"))))


def keyword_model_report(tagged: DataFrame, seeds: DataFrame, scored: DataFrame, themes: str = "themes") -> DataFrame:
    """(key, theme, value) of a model trained on keyword seeds: texts, seeds in all and by theme, texts without a rule, shares."""
    no_rule = tagged.agg(F.count_if(F.size(themes) == 0).alias("n")).select(*_report("narratives_matching_no_rule", F.col("n")))
    by_theme = keep(seeds.groupBy("theme").agg(F.count(F.lit(1)).alias("n")), "seed-counts")
    rows = by_theme.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(*_report("training_rows", F.col("n")))
    per_theme = by_theme.select(*_report("seed_rows_by_theme", F.col("n"), F.col("theme")))
    return _shares(scored).unionByName(no_rule).unionByName(rows).unionByName(per_theme)


def labels_model_report(predicted: DataFrame, scored: DataFrame) -> DataFrame:
    """(key, theme, value) of a model trained on labels: texts, training rows, agreement and F1 of the folds, shares."""
    scores = fold_scores(predicted).select(*_report("", F.col("value"), F.col("theme")), "metric")
    named = scores.withColumn("key", F.concat(F.lit("cv_"), "metric")).drop("metric")
    rows = predicted.agg(F.count(F.lit(1)).alias("n")).select(*_report("training_rows", F.col("n")))
    return _shares(scored).unionByName(rows).unionByName(named)
