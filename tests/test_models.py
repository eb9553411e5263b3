import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.ordering import hash_order
from loanlens.operators import attribution, evaluation, models, preprocess, sampling, scoring
from loanlens.registry.scoring import requests
from loanlens.sources import tables
from loanlens.streaming.scoring import request_stream, score_stream


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 12, 500) / 11.0
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert evaluation.roc_auc(df, "y", "s").first()[0] == pytest.approx(brute_auc(y, s))
    points = evaluation.roc_curve(df, "y", "s", drop_collinear=False).toPandas()
    assert len(points) == 13 and np.trapezoid(points.tpr, points.fpr) == pytest.approx(brute_auc(y, s))
    thinned = evaluation.roc_curve(df, "y", "s").toPandas()
    assert len(thinned) <= 13 and np.trapezoid(thinned.tpr, thinned.fpr) == pytest.approx(brute_auc(y, s))


def test_empty_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert evaluation.roc_auc(df, "y", "s").first()[0] is None
    r = evaluation.threshold_scores(df, "y", "s").first()
    assert (r.accuracy, r.recall, r.precision, r.f1) == (0.0, 0.0, 0.0, 0.0)
    assert [tuple(x) for x in evaluation.confusion_matrix(df, "y", "s").collect()] == [(0, 0, 0), (0, 1, 0), (1, 0, 2), (1, 1, 0)]


def test_half_rounds_to_even(spark):
    df = spark.createDataFrame([(0.5,), (0.500001,)], "p double")
    assert [r[0] for r in df.select(evaluation.predicted_class("p")).collect()] == [0, 1]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    n = 900
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.5 * rng.normal(size=n) > 0.9).astype(int)
    pdf = pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "noise": x[:, 2], "c": np.where(x[:, 0] > 0, "hi", "lo"), "label": y})
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("id") % 17 != 0, F.col("a")))
    return df.persist()


def test_linear_model_has_the_stated_optimum(spark, planted):
    ready = planted.filter("a is not null").select("label", array_to_vector(F.array("a", "b", "noise")).alias("features"))
    model = models.linear_estimator(ready, "label", c=0.5, max_iter=300).setTol(1e-12).fit(ready)
    pdf = ready.toPandas()
    x, y = np.stack(pdf.features.map(lambda v: v.toArray())), pdf.label.to_numpy()
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # gradient of |w|^2 / 2 + C * sum(loss) vanishes
    assert np.allclose(w + 0.5 * x.T @ (p - y), 0, atol=2e-2) and abs((p - y).sum()) < 2e-2


def test_grid_folds_and_search_find_the_signal(spark, planted):
    ready = planted.select("id", "label", array_to_vector(F.array(F.coalesce("a", F.lit(0.0)), "b", "noise")).alias("features"))
    train, validation = sampling.stratified_split(ready, "label", ["id"])
    fits = {"linear": lambda d: models.linear_estimator(d, "label").fit(d), "tree": lambda d: models.tree_estimator("label", depth=4).fit(d),
            "forest": lambda d: models.forest_estimator("label", trees=10, depth=5).fit(d)}
    grid = models.auc_grid(spark, fits, {"all": train}, validation, "label").toPandas()
    assert len(grid) == 3 and (grid.roc_auc > 0.75).all()
    scores = models.cross_val_scores({"linear": models.linear_estimator(ready, "label")}, ready, "label", ["id"])
    assert scores.count() == 3 and models.mean_scores(scores).first().roc_auc > 0.85
    space = {**models.SEARCH_SPACE, "min_data_in_leaf": ("int", 5, 10)}
    found = models.random_search(ready, "label", ["id"], trials=2, rounds=4, space=space).collect()
    assert len(found) == 2 and found[0].roc_auc >= found[1].roc_auc > 0.6


def test_search_points_stay_in_range():
    points = models.draw_trials(50, seed=1)
    assert points == models.draw_trials(50, seed=1)
    for p in points:
        for name, (_, low, high) in models.SEARCH_SPACE.items():
            assert low <= p[name] <= high


def test_boosting_importance_and_elimination(spark, planted, tmp_path):
    train, validation = (d.persist() for d in sampling.stratified_split(planted, "label", ["id"]))
    columns = ["a", "b", "noise", "c"]
    model = models.fit_boosting(train, validation, "label", columns, rounds=8, params={"maxDepth": 3})
    assert models.auc(model, validation, "label") > 0.85 and 1 <= models.boosting_rounds(model) <= 8
    assert models.boosting_rounds(models.refit_boosting(planted, model, "label", columns)) == models.boosting_rounds(model)
    tables.save_model(model, str(tmp_path / "m"))
    a = scoring.score(validation, model, ["id"]).orderBy("id").collect()
    assert a == scoring.score(validation, tables.load_model(str(tmp_path / "m")), ["id"]).orderBy("id").collect()
    drops = {r.feature: r.importance for r in attribution.permutation_importance(model, validation, "label", ["id"], columns).collect()}
    assert drops["b"] > drops["noise"]
    unseen = validation.limit(3).withColumn("c", F.lit("new"))
    assert models.default_probability(model.transform(unseen)).count() == 3
    steps = attribution.recursive_elimination(train, validation, "label", columns, drop_each=2, max_iter=5, rounds=4).collect()
    assert [s.n_features for s in steps] == [4, 2] and sorted(d for s in steps for d in s.dropped) == sorted(columns)
    kept = attribution.refit_without(train, validation, "label", columns, ["noise"], rounds=3)[1]
    assert kept == ["a", "b", "c"]


def test_linear_attribution_sums_to_the_score(spark, planted):
    ready = planted.select("id", F.coalesce("a", F.lit(0.0)).alias("a"), "b")
    weights = {"a": 2.0, "b": -1.0}
    means = attribution.column_means(ready, ["a", "b"])
    phi = attribution.linear_attribution(ready, weights, means)
    both = phi.join(ready.select("id", (2 * F.col("a") - F.col("b")).alias("score")), "id")
    base = 2 * means["a"] - means["b"]
    assert both.filter(F.abs(F.col("a") + F.col("b") + base - F.col("score")) > 1e-9).count() == 0
    vectors = ready.select(array_to_vector(F.array("a", "b")).alias("features"))
    a = {r.feature: r.importance for r in attribution.vector_attribution(vectors, vectors, [2.0, -1.0], ["a", "b"]).collect()}
    b = {r.feature: r.importance for r in attribution.mean_abs(phi, ["a", "b"]).collect()}
    assert a == pytest.approx(b)
    assert attribution.zero_importance(spark.createDataFrame([("x", 0.0), ("y", 1.0)], "feature string, importance double")) == ["x"]


def test_contract_reports_each_problem(spark, sf_dir):
    row = requests(spark, sf_dir).filter("SK_ID_CURR = 120").drop("EXT_SOURCE_1")
    bad = row.withColumns({"CODE_GENDER": F.lit("X"), "DAYS_BIRTH": F.lit(1.5), "AMT_CREDIT": F.lit("abc"), "FLAG_EMAIL": F.lit("1"),
                           "AMT_ANNUITY": F.lit(None).cast("double")})
    assert scoring.check_requests(bad).first()["violations"] == [
        "CODE_GENDER: not allowed", "AMT_CREDIT: not a number", "AMT_ANNUITY: missing", "DAYS_BIRTH: not an integer",
        "EXT_SOURCE_1: field required"]


def test_one_bad_request_does_not_end_the_batch(spark, sf_dir):
    row = requests(spark, sf_dir).filter("SK_ID_CURR = 120")
    texts = row.select(*[F.col(c).cast("string").alias(c) for c in row.columns])
    wild = texts.withColumns({"SK_ID_CURR": F.lit("1"), "DAYS_BIRTH": F.lit("1e30"), "CNT_CHILDREN": F.lit("two"), "AMT_CREDIT": F.lit("NaN")})
    good = texts.withColumns({"DAYS_BIRTH": F.lit("7.0"), "AMT_CREDIT": F.lit("1e3")})
    valid, held = scoring.split_requests(good.union(wild))
    assert [(r.SK_ID_CURR, r.DAYS_BIRTH, r.AMT_CREDIT) for r in valid.collect()] == [("120", 7, 1000.0)]
    assert held.first().violations == ["CNT_CHILDREN: not an integer", "AMT_CREDIT: not a number", "DAYS_BIRTH: not an integer"]


def test_roc_curve_keeps_its_ends(spark):
    df = spark.createDataFrame(list(zip([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [0, 0, 1, 0, 1, 1])), "s double, y int")
    points = [(r.threshold, r.fpr, r.tpr) for r in evaluation.roc_curve(df, "y", "s").collect()]
    third = 1 / 3
    assert [x for p in points for x in p] == pytest.approx([x for p in [(float("inf"), 0, 0), (0.9, third, 0), (0.8, 2 * third, 0), (0.7, 2 * third, third),
                                    (0.6, 1, third), (0.4, 1, 1)] for x in p])


def test_patience_outlasts_a_flat_stretch():
    assert models.best_round([5, 4, 4.1, 4.2, 3, 3.5], 3) == 5
    assert models.best_round([5, 4, 4.1, 4.2, 4.3, 3], 3) == 2
    assert models.best_round([1], 3) == 1


def test_small_steps_use_their_budget(spark, planted):
    train, validation = sampling.stratified_split(planted, "label", ["id"])
    model = models.fit_boosting(train, validation, "label", ["a", "b"], rounds=12, params={"stepSize": 0.01, "maxDepth": 2})
    assert models.boosting_rounds(model) == 12


def test_streamed_scores_equal_batch_scores(spark, sf_dir, tmp_path):
    ids = T.StructType([T.StructField("SK_ID_CURR", T.LongType())])
    schema = {f.name: f.dataType for f in scoring.contract_schema().fields}
    base = requests(spark, sf_dir)
    typed = base.select("SK_ID_CURR", *[F.col(c).cast(k).alias(c) for c, k in schema.items()])
    typed.repartition(3).write.parquet(str(tmp_path / "in"))
    train, _ = scoring.split_requests(typed)
    train = train.withColumn("label", (F.col("EXT_SOURCE_2") < 5).cast("int"))
    columns = ["EXT_SOURCE_2", "AMT_CREDIT", "CODE_GENDER"]
    model = models.fit_boosting(train, train, "label", columns, rounds=2)
    stream = request_stream(spark, str(tmp_path / "in"), ids)
    out, held = str(tmp_path / "scores"), str(tmp_path / "held")
    score_stream(stream, model, ["SK_ID_CURR"], out, held, str(tmp_path / "ckpt")).awaitTermination()
    valid, quarantined = scoring.split_requests(typed)
    want = scoring.score(valid, model, ["SK_ID_CURR"])
    got = spark.read.parquet(out).select("SK_ID_CURR", "DefaultProbability")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(held).count() == quarantined.count() > 0


def test_permutation_of_all_columns_takes_the_jobs_of_one(spark):
    """The same importances by hand, from the same dealing; as many jobs for four columns as for one."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400), "c": rng.choice(list("xyz"), 400), "noise": rng.normal(size=400)})
    pdf["label"] = (pdf.a + (pdf.c == "x") + 0.3 * rng.normal(size=400) > 0.4).astype(int)
    df = tables.stage(spark.createDataFrame(pdf))
    columns = ["a", "b", "c", "noise"]
    model = models.fit_boosting(df, df, "label", columns, rounds=4)
    jobs, got = [], {}
    for k, own in enumerate((columns[:1], columns)):
        spark.sparkContext.setJobGroup(f"permutation {k}", "")
        got = {r.feature: r.importance for r in attribution.permutation_importance(model, df, "label", ["id"], own).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"permutation {k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 2  # adaptive execution may split a job
    whole = df.withColumn("one", F.lit(1))
    seats, dealt = (hash_order(whole, "one", ["id"], s, "seat").drop("one") for s in (0, 1))
    base = models.auc(model, df, "label")
    for c in columns:
        moved = seats.drop(c).join(dealt.select("seat", c), "seat")
        assert got[c] == pytest.approx(base - models.auc(model, moved, "label"))
    assert got["a"] > 0.1 > abs(got["noise"])


def test_permutation_by_slots_scores_vectors(spark, planted, monkeypatch):
    """Rows become vectors once, not once per variant; the importances are those by whole rows."""
    columns = ["c", "a", "noise", "b"]
    train = tables.stage(planted)
    model = models.fit_boosting(train, train, "label", columns, rounds=4)
    assert models.input_slots(model) == {"c": 0, "a": 1, "noise": 2, "b": 3}
    assert models.input_slots(model.stages[-1]) == {}
    seen = attribution._slot_scores(model, train, "label", ["id"], [2, 0], 0)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "index__" not in plan and "number__" not in plan
    assert seen.count() == 3 * train.count()
    for own in (columns, ["b", "c"]):
        by_slots = attribution.permutation_importance(model, train, "label", ["id"], own).collect()
        with monkeypatch.context() as m:
            m.setattr(attribution, "input_slots", lambda model: {})
            assert attribution.permutation_importance(model, train, "label", ["id"], own).collect() == by_slots
    assert by_slots[0].importance > 0
