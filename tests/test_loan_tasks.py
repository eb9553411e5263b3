"""The loan joins get more tasks as there are more loans."""

from loanlens.operators import previous
from loanlens.registry.common import Lending
from loanlens.registry.previous import unapproved_fill


def test_tasks_grow_with_loans_and_rows_stay(spark, sf_dir, monkeypatch):
    want = sorted(map(str, unapproved_fill(spark, sf_dir).collect()))
    monkeypatch.setattr(previous, "LOANS_PER_TASK", 5)
    t = Lending(spark, sf_dir)
    loans = t.prev_apps.count()
    assert loans > 1000
    joined = previous.loan_features(t.prev_apps, t.pos_cash, t.installments, t.credit_card, "ROW_TIEBREAK")
    assert joined.rdd.getNumPartitions() >= loans / 5
    assert sorted(map(str, unapproved_fill(spark, sf_dir).collect())) == want
