import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from caselens.operators import textmodel

WORDS = {"fee": ["annual", "fee", "charged", "renewal"], "lounge": ["airport", "lounge", "guest", "flight"], "fraud": ["stolen", "number", "dispute", "merchant"]}
COMMON = ["card", "bank", "called", "month", "told", "them"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        label = list(WORDS)[i % 3]
        out.append((i, label, " ".join(rnd.choices(WORDS[label], k=6) + rnd.choices(COMMON, k=10))))
    return out


def term_counts(spark, texts, stop):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = textmodel.Terms(inputCol="t", outputCol="terms", stopWords=stop).transform(df).collect()
    return {r.i: Counter(r.terms) for r in rows}


def test_term_counts_equal_a_plain_count(spark):
    text = "Café, café! The CAFE's x über-résumé is naïve: the bank_1 and the\nbank_1 42 é"
    got = term_counts(spark, [text, "", "a the of", None, "one"], ["the", "is", "and"])
    plain = "cafe, cafe! the cafe's x uber-resume is naive: the bank_1 and the\nbank_1 42 e"
    words = [w for w in re.findall(r"\w\w+", plain) if w not in ("the", "is", "and")]
    assert got[0] == Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
    assert got[1] == got[3] == Counter() and got[2] == Counter({"of": 1}) and got[4] == Counter({"one": 1})


def test_accents_of_every_script_and_marks_after_letters(spark):
    words = [
        "cafe\u0301", "CAFÉ", "ﬁne ﬂat", "Ά\u0301λφα", "йод", "Việt Nam", "ＦＵＬＬ", "Ⅷ ½", "e\u0327\u0301le\u0300ve", "𝐛𝐨𝐥𝐝", "ǖ ǆ", "Ångström", "naïve ﬀ" * 3,
    ]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", textmodel.without_accents(F.lower("t")).alias("p")).collect()}
    for i, w in enumerate(words):
        marked = unicodedata.normalize("NFKD", w.lower())
        assert got[i] == "".join(c for c in marked if not unicodedata.combining(c)), w
    counts = term_counts(spark, ["Cafe\u0301 CAFÉ cafe café"], [])
    assert counts[0] == Counter({"cafe": 4, "cafe cafe": 3})


def test_vocabulary_works_the_terms_out_once(spark, monkeypatch):
    plans, keep = [], textmodel.keep
    monkeypatch.setattr(textmodel, "keep", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, name))[1])
    df = spark.createDataFrame([("b a b a b",), ("aa bb aa bb",), ("",), (None,), ("bb",)], "t string").repartition(2)
    docs = textmodel.Terms(inputCol="t", outputCol="terms").transform(df)
    rows = textmodel.vocabulary(docs, 1, None).collect()
    assert {(r.term, r.df, r.total) for r in rows} == {("aa", 1, 2), ("bb", 2, 3), ("aa bb", 1, 2), ("bb aa", 1, 1)}
    assert plans[0].count("regexp_extract_all") == 1


def test_vocabulary_is_numbered_by_total_and_term_at_any_size(spark):
    texts = [" ".join(f"w{(i * k) % 97:02d}" for k in range(1, 40)) for i in range(60)] + ["w01 " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    docs = textmodel.Terms(inputCol="t", outputCol="terms").transform(df)
    per_text = [Counter(a + (f" {b}" if b else "") for a, b in [(w, None) for w in t.split()] + list(zip(t.split(), t.split()[1:]))) for t in texts]
    df_of, total = Counter(x for c in per_text for x in c), sum(per_text, Counter())
    want = sorted((x for x in df_of if df_of[x] >= 3), key=lambda x: (-total[x], x))
    rows = textmodel.vocabulary(docs, 3, None).collect()
    assert sorted((r["index"], r["term"], r["df"], r["total"]) for r in rows) == [(k, x, df_of[x], total[x]) for k, x in enumerate(want)]
    assert {r.term for r in textmodel.vocabulary(docs, 3, 7).collect()} == set(want[:7])
    text = textmodel.vocabulary(docs, 3, None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SinglePartition" not in text


def test_idf_without_the_rare_and_beyond_the_limit(spark):
    docs = spark.createDataFrame([([x] * n,) for x, n in (("a", 5), ("a", 1), ("b", 1), ("b", 1), ("c", 9))], "terms array<string>")
    counter = CountVectorizerModel.from_vocabulary(["a", "b", "c"], inputCol="terms", outputCol="counts")
    frame = textmodel.Dampened(inputCol="counts", outputCol="dampened").transform(counter.transform(docs))
    assert sorted(r.dampened.values[0] for r in frame.collect()) == pytest.approx([1, 1, 1, 1 + math.log(5), 1 + math.log(9)])
    weights = lambda most: list(textmodel.ShiftedIdf("dampened", "w", "counts", 2, most, np.arange(3)).fit(frame).getScalingVec())
    assert weights(None) == pytest.approx([math.log(6 / 3) + 1, math.log(6 / 3) + 1, 0])
    assert weights(1) == pytest.approx([math.log(6 / 3) + 1, 0, 0])


def test_model_learns_scores_in_one_map_and_survives_a_round_trip(spark, tmp_path):
    train = spark.createDataFrame([*texts(90), (500, None, "no label")], "id int, label string, t string")
    model = textmodel.fit_theme_model(train, "id", "t", "label")
    path = str(tmp_path / "corpus")
    spark.createDataFrame([*[(i, x, t) for i, x, t in texts(30, seed=2)], (99, "none", "zzz qqq"), (100, "none", None)], "id int, terms string, t string").write.parquet(path)
    scored = textmodel.predict_themes(model, spark.read.parquet(path), "t")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan and plan.count("FileScan") == 1
    assert scored.columns == ["id", "terms", "primary_theme", "confidence"]
    got = {r.id: r for r in scored.collect()}
    assert all(got[i].primary_theme == label for i, label, _ in texts(30, seed=2))
    assert all(1 / 3 <= r.confidence <= 1 for r in got.values())
    # A text without any known term is scored by the intercepts alone.
    at = model.stages[-2].interceptVector.toArray()
    assert got[99].confidence == got[100].confidence == pytest.approx(max(math.exp(b) for b in at) / sum(math.exp(b) for b in at))
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    again = textmodel.predict_themes(loaded, spark.read.parquet(path).repartition(7), "t").collect()
    assert {r.id: r.confidence for r in again} == pytest.approx({i: r.confidence for i, r in got.items()})


def test_given_coefficients(spark):
    c = np.array([[1.0, -2.0], [0.5, 3.0], [-1.0, 0.25]])
    model = textmodel.given_theme_model(spark, "t", ["x", "y", "z"], ["aa", "bb"], [1.5, 2.0], c, [0.1, 0.0, -0.2], [])
    df = spark.createDataFrame([(1, "aa aa bb"), (2, "cc"), (3, "bb")], "id int, t string")
    got = {r.id: r for r in textmodel.predict_themes(model, df, "t").collect()}
    for i, tf in ((1, [2, 1]), (2, [0, 0]), (3, [0, 1])):
        x = np.array([(1 + math.log(n)) * w if n else 0.0 for n, w in zip(tf, [1.5, 2.0])])
        z = c @ (x / (np.linalg.norm(x) or 1)) + [0.1, 0.0, -0.2]
        p = np.exp(z) / np.exp(z).sum()
        assert got[i].primary_theme == "xyz"[p.argmax()] and got[i].confidence == pytest.approx(p.max())


def test_labels_train_the_model_when_there_are_enough(spark):
    rows = texts(60)
    corpus = spark.createDataFrame([(i, t) for i, _, t in rows], "complaint_id int, narrative string")
    labels = spark.createDataFrame([(i, label) for i, label, _ in rows[:45]], "complaint_id int, primary_theme string")
    got = {r.complaint_id: r for r in textmodel.theme_model(corpus, labels, min_labels=40).collect()}
    assert {r.label_source for r in got.values()} == {"llm_distilled"} and len(got) == 60
    assert all(got[i].primary_theme == label for i, label, _ in rows)


def test_keyword_mode_calls_unsure_texts_other(spark):
    seeds = [(i, f"the annual fee was raised again {'soon' if i % 2 else 'now'}") for i in range(12)]
    seeds += [(20 + i, f"the airport lounge turned guests away {'soon' if i % 2 else 'now'}") for i in range(12)]
    seeds += [(40 + i, f"a stolen number and a dispute {'soon' if i % 2 else 'now'}") for i in range(12)]
    corpus = spark.createDataFrame([*seeds, (90, "completely unrelated words"), (91, "raised again")], "complaint_id int, narrative string")
    got = {r.complaint_id: r for r in textmodel.theme_model(corpus, None).collect()}
    assert {r.label_source for r in got.values()} == {"keyword_fallback"}
    assert got[0].primary_theme == "annual_fee" and got[40].primary_theme == "dispute_fraud"
    assert got[90].primary_theme == "other"
    assert got[91].primary_theme in ("annual_fee", "other")


def test_rules_run_once_for_seeds_and_unsure_rows(spark, monkeypatch):
    ran = []
    plain = textmodel.with_keyword_themes
    monkeypatch.setattr(textmodel, "with_keyword_themes", lambda *a: ran.append(a) or plain(*a))
    corpus = spark.createDataFrame([(i, f"the annual fee {i}" if i % 2 else f"a stolen number {i}") for i in range(12)], "complaint_id int, narrative string")
    scored = textmodel.theme_model(corpus, mode="keywords")
    assert len(ran) == 1 and "unauthori" not in scored._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        textmodel.theme_model(corpus, mode="guess")


def test_cross_validation(spark):
    rare = [(900 + i, "rare", "some card words") for i in range(4)] + [(990, None, "unlabelled")]
    df = spark.createDataFrame(texts(45) + rare, "id int, label string, t string")
    got = {(r.metric, r.theme): (r.value, r.rows) for r in textmodel.theme_model_cv(df, "id", "t", "label", folds=3).collect()}
    assert set(got) == {("agreement", None), ("macro_f1", None), ("f1", "rare"), *(("f1", k) for k in WORDS)}
    assert got["agreement", None] == (1.0, 45) and got["f1", "rare"] == (None, 4)


def test_folds_hold_like_shares_and_each_row_is_scored_without_its_own(spark):
    # A row's label is told by a word of its own only: a model that had seen the row would know it.
    rows = [(i, "ab"[i % 2], f"same words here own{i} own{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label string, t string")
    folds = textmodel.stratified_folds(df, "id", "label", 4)
    assert Counter((r.label, r.fold) for r in folds.collect()) == {(x, k): 5 for x in "ab" for k in range(4)}
    predicted, model = textmodel.cross_validated(df, "id", "t", "label", folds=4, min_df=1)
    hits = sum(r.label == r.primary_theme for r in predicted.collect())
    assert predicted.count() == 40 and hits < 40
    whole = textmodel.predict_themes(model, df.withColumnRenamed("t", "x"), "x").collect()
    assert all(r.label == r.primary_theme for r in whole)


def test_scores_of_folds_equal_plain_counts(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")] + [("c", "a")] + [("d", None)] * 2
    got = {(r.metric, r.theme): (r.value, r.rows) for r in textmodel.fold_scores(spark.createDataFrame(pairs, "label string, primary_theme string")).collect()}
    f1 = {"a": 2 * 5 / (7 + 6), "b": 2 * 3 / (4 + 5), "c": 0.0}
    assert got == {
        ("agreement", None): (round(8 / 12, 3), 12), ("macro_f1", None): (round(sum(f1.values()) / 3, 3), 12), ("f1", "d"): (None, 2),
        ("f1", "a"): (round(f1["a"], 3), 7), ("f1", "b"): (round(f1["b"], 3), 4), ("f1", "c"): (0.0, 1),
    }


def test_share(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)], "primary_theme string")
    assert {r.primary_theme: r.share_pct for r in textmodel.theme_model_share(df).collect()} == {"a": 66.7, "b": 33.3}


def test_equal_rows_are_scored_one_by_one(spark):
    from caselens.operators import textmodel

    rows = [("a", "fee fee charged again"), ("a", "fee fee charged again"), ("b", "points points lost today")] * 6
    train = spark.createDataFrame([(k, t, "x" if i == "a" else "y") for k, (i, t) in enumerate(rows)], "id int, text string, theme string")
    model = textmodel.fit_theme_model(train, "id", "text", "theme")
    scored = textmodel.predict_themes(model, train.select("text"), "text").collect()
    assert len(scored) == len(rows)


def test_only_terms_that_a_fold_uses_are_held(spark):
    from caselens.operators import textmodel

    rnd = random.Random(5)
    rows = [(i, i % 3, " ".join(rnd.choices([f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=12))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, fold int, t string")
    docs = textmodel.Terms(inputCol="t", outputCol="terms").transform(df).drop("t")
    every = textmodel.vocabulary(docs, 2, None).collect()
    number = {r.term: r["index"] for r in every}
    want = {r.term for r in every if r["index"] < 15}
    for k in range(3):
        terms = [(r.id, x) for r in docs.filter(F.col("fold") != k).collect() for x in r.terms]
        total, held = Counter(x for _, x in terms), Counter(x for _, x in set(terms))
        used = [x for x in total if held[x] >= 2]
        want |= set(sorted(used, key=lambda x: (-total[x], number[x]))[:15])
    found = textmodel.folds_vocabulary(docs, 3, 2, 15).collect()
    assert {(r.term, r["index"]) for r in found} == {(x, number[x]) for x in want} and 15 < len(want) < len(every)
    assert textmodel.folds_vocabulary(docs, 3, 2, None).count() == len(every)
    labelled = df.withColumn("label", F.when(F.rlike("t", F.lit(r"w1\b")), "a").otherwise("b"))
    _, model = textmodel.cross_validated(labelled, "id", "t", "label", folds=3, min_df=2, max_features=15)
    assert len(model.stages[1].vocabulary) < len(every)


def test_fits_and_tasks_are_bounded():
    from caselens.operators import textmodel

    assert textmodel.fits_at_once(5, 4, 1000) == 5 and textmodel.fits_at_once(5, 4, 200_000) == 1
    assert [textmodel.regression_tasks(n, 6) for n in (0, 1_000_000, 10_000_000, 40_000_000, 2_000_000_000)] == [1, 1, 5, 12, 125]
