"""Registered queries that train models read all rows and train as long as the library does by default."""

from loanlens.operators import attribution, boosting, models, sampling
from loanlens.plans import modelling as plan
from loanlens.registry import modelling, scoring
from loanlens.sources import tables


def first_clients(spark, sf_dir):
    df = modelling.labelled(spark, sf_dir)
    return lambda *_: df


def test_halving_search_reads_all_rows_for_all_its_rounds(spark, sf_dir, monkeypatch):
    clients = first_clients(spark, sf_dir)
    monkeypatch.setattr(modelling, "labelled", clients)
    seen = {}

    def search(df, *args, **options):
        seen.update(rows=df.count(), **options)
        return df

    monkeypatch.setattr(boosting, "halving_search", search)
    modelling.halving_search(spark, sf_dir)
    assert seen["rows"] == clients().count()
    assert seen["trials"] == 200 and seen["k"] == 3 and not {"rounds", "patience", "growth", "finalists"} & set(seen)


def test_recursive_elimination_trains_to_the_end(spark, sf_dir, monkeypatch):
    clients, fits = first_clients(spark, sf_dir), []
    monkeypatch.setattr(modelling, "labelled", clients)
    short = models.fit_boosting

    def fit(train, validation, label, columns, rounds=models.ROUNDS, weight=None, params=None, seed=0, patience=models.PATIENCE, first=None):
        fits.append((len(columns), rounds, patience, first))
        return short(train.limit(60), validation, label, columns, 1, params={"maxDepth": 1})

    monkeypatch.setattr(attribution, "fit_boosting", fit)
    rows = modelling.recursive_elimination(spark, sf_dir).collect()
    count = len(modelling._tree_columns(clients()))
    assert [r.n_features for r in rows] == [f[0] for f in fits] == list(range(count, 0, -10))[:10]
    assert {f[1:3] for f in fits} == {(2000, 100)}
    assert [f[3] for f in fits] == [None] + [101] * (len(fits) - 1)


def test_the_first_stretch_changes_no_model(spark):
    df = spark.range(400).selectExpr("id", "cast(id * 37 % 101 as double) as a", "cast(id * 53 % 89 as double) as b",
                                     "cast((id * 37 % 101 + id * 71 % 40 > 80) as int) as label")
    train, validation = (tables.stage(d) for d in sampling.stratified_split(df, "label", ["id"]))
    fits = [models.fit_boosting(train, validation, "label", ["a", "b"], rounds=12, params={"maxDepth": 2, "stepSize": 0.9}, patience=2, first=first)
            for first in (None, 3, 9)]
    assert len({f.stages[-1].toDebugString.partition("\n")[2] for f in fits}) == 1


def test_tree_scores_train_to_the_end(spark, sf_dir, monkeypatch):
    fits, short = [], models.fit_boosting

    def fit(train, validation, label, columns, rounds=models.ROUNDS, weight=None, **options):
        fits.append((train.count() + validation.count(), rounds, options))
        return short(train, validation, label, columns, 1, weight, {"maxDepth": 1})

    monkeypatch.setattr(plan.models, "fit_boosting", fit)
    scores = scoring.tree_scores(spark, sf_dir)
    assert fits == [(scores.count(), 2000, {})]
