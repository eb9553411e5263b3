"""Edge cases of the loan, client and bureau features on handmade rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from loanlens.operators import bureau, cleaning, clients, previous
from loanlens.plans import features
from loanlens.registry.common import TIE, Lending

POS = "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double, NAME_CONTRACT_STATUS string, SK_DPD int, T long"


def pos(spark, rows):
    out = previous.loan_pos_features(spark.createDataFrame(rows, POS), "T").collect()
    return {r.SK_ID_PREV: r for r in out}


def test_loan_length(spark):
    got = pos(spark, [
        (1, 1, -5, 3.0, 9.0, "Completed", 0, 0), (1, 1, -1, 3.0, 8.0, "Active", 0, 1),      # completed: span only
        (2, 1, -5, 3.0, None, "Active", 0, 0), (2, 1, -2, 3.0, None, "Active", 0, 1),       # nothing known: span only
        (3, 1, -5, 3.0, 9.0, "Active", 0, 0), (3, 1, -2, 3.0, 4.0, "Active", 0, 1),         # span + due at latest
        (4, 1, -5, 3.0, 9.0, "Active", 0, 0), (4, 1, -2, 3.0, None, "Active", 0, 1),        # latest does not say
        (5, 1, -2, 3.0, 7.0, "Active", 0, 1), (5, 1, -2, 4.0, 6.0, "Active", None, 0),      # tie: lowest tie-break
    ])
    assert {k: r.LOAN_LENGTH for k, r in got.items()} == {1: 5.0, 2: 4.0, 3: 8.0, 4: None, 5: 7.0}
    assert {k: r.INSTALLMENT_CHANGED for k, r in got.items()} == {1: "NO", 2: "NO", 3: "NO", 4: "NO", 5: "YES"}
    assert {k: r.HAD_DPD for k, r in got.items()} == {1: "NO", 2: "NO", 3: "NO", 4: "NO", 5: "YES"}
    assert got[1].IS_COMPLETED == "YES" and got[2].IS_COMPLETED == "NO"


def test_any_status_and_any_tie(spark):
    rows = [(1, -1, "10", 2 ** 62), (1, -1, "C", 2 ** 62 + 1), (2, -3, "", -5), (2, -3, "0", 7), (3, -2, "Closed", 0), (4, -1, None, 0), (5, None, "1", 0)]
    schema = "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string, T long"
    out = bureau.credit_status_features(spark.createDataFrame(rows, schema), "T")
    assert {r.SK_ID_BUREAU: r.CURRENT_STATUS for r in out.collect()} == {1: "10", 2: "", 3: "Closed", 4: None, 5: None}
    assert {r.SK_ID_BUREAU: r.HAD_1_DPD for r in out.collect()} == {1: "NO", 2: "NO", 3: "NO", 4: "NO", 5: "YES"}
    with pytest.raises(Exception, match="seven bytes"):
        bureau.credit_status_features(spark.createDataFrame([(1, -1, "far too long", 0)], schema), "T").collect()


def test_card_features_leave_out_unknown_and_negative_drawings(spark):
    card = spark.createDataFrame(
        [(1, 9, -1, -1.0, 10.0, 5.0, 9.0, "Completed", 0), (1, 9, -2, None, 10.0, 5.0, 1.0, "Active", 3), (1, 9, -3, 20.0, 10.0, 5.0, 1.0, "Active", 0)],
        "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, AMT_DRAWINGS_CURRENT double, AMT_CREDIT_LIMIT_ACTUAL double, "
        "AMT_INST_MIN_REGULARITY double, AMT_PAYMENT_CURRENT double, NAME_CONTRACT_STATUS string, SK_DPD int")
    r = previous.loan_card_features(card).first()
    assert (r.IS_COMPLETED, r.LAST_SNAPSHOT, r.HAD_DPD, r.AVG_DRAWINGS, r.EXCEEDED_LIMIT, r.UNDERPAID) == ("NO", -3, "NO", 20.0, "YES", "YES")
    _, whole, _ = previous.client_history_features(
        spark.createDataFrame([], POS), card, spark.createDataFrame([], "SK_ID_CURR long, AMT_INSTALMENT double"))
    assert whole.first()["AVERAGE_DRAWINGS_PREV"] == 9.5  # the client level sees all rows


def test_join_keeps_every_application(spark, sf_dir):
    t = Lending(spark, sf_dir)
    loans = previous.loan_features(t.prev_apps, t.pos_cash, t.installments, t.credit_card, TIE)
    assert loans.count() == t.prev_apps.count()
    by_client = t.previous_features()
    assert by_client.count() == by_client.select("SK_ID_CURR").distinct().count()


def test_results_do_not_depend_on_row_order(spark, sf_dir):
    t = Lending(spark, sf_dir)
    a = features.previous_features(t.prev_apps, t.pos_cash, t.installments, t.credit_card, TIE)
    shuffled = [x.repartition(5, F.rand(3)) for x in (t.prev_apps, t.pos_cash, t.installments, t.credit_card)]
    b = features.previous_features(*shuffled, TIE)
    columns = [c for c, k in a.dtypes if k != "double"]
    assert sorted(map(tuple, a.select(columns).collect()), key=str) == sorted(map(tuple, b.select(columns).collect()), key=str)


def test_unapproved_fills(spark):
    loans = spark.createDataFrame(
        [("Refused", "UNKNOWN", None, None, None, None, -10), ("Approved", "UNKNOWN", None, None, None, 51.0, -10),
         ("Approved", "NO", 3, 4.0, 5.0, 51.0, -10), ("Approved", "NO", 3, 4.0, None, None, -10)],
        "NAME_CONTRACT_STATUS string, IS_COMPLETED string, INSTALLMENT_COUNT long, CNT_PAYMENT double, LOAN_LENGTH double, "
        "DAYS_TERMINATION double, DAYS_DECISION int")
    got = [(r.IS_COMPLETED, r.INSTALLMENT_COUNT, r.CNT_PAYMENT, r.LOAN_LENGTH) for r in previous.fill_unapproved(loans).collect()]
    assert got == [("YES", 0, 0.0, 0.0), ("UNKNOWN", None, None, 3.0), ("NO", 3, 4.0, 5.0), ("NO", 3, 4.0, None)]


def test_down_payment_fill(spark):
    df = spark.createDataFrame(
        [(None, None, None, 5.0, "Approved"), (None, 10.0, None, 5.0, "Approved"), (1.0, 10.0, None, None, "Refused"), (1.0, 10.0, 0.5, 5.0, "Refused")],
        "AMT_ANNUITY double, AMT_CREDIT double, RATE_DOWN_PAYMENT double, AMT_DOWN_PAYMENT double, NAME_CONTRACT_STATUS string")
    got = [tuple(r) for r in cleaning.fill_amounts(df).collect()]
    assert [g[:4] for g in got] == [(0.0, 0.0, 0.0, 0.0), (0.0, 10.0, None, 5.0), (1.0, 10.0, 0.0, 0.0), (1.0, 10.0, 0.5, 5.0)]


def test_negative_down_payment_clears_its_rate(spark):
    df = spark.createDataFrame([(-1.0, -5.0, 0.3, "XNA", 365243.0), (7.0, 5.0, 0.3, "XAP ", 1.0)],
                               "SELLERPLACE_AREA double, AMT_DOWN_PAYMENT double, RATE_DOWN_PAYMENT double, T string, DAYS_TERMINATION double")
    assert [tuple(r) for r in cleaning.sentinels_to_null(df).collect()] == [(None, None, None, None, None), (7.0, 5.0, 0.3, "XAP ", 1.0)]


def test_unlisted_yield_group_is_an_error(spark):
    df = spark.createDataFrame([("weird",)], "NAME_YIELD_GROUP string")
    with pytest.raises(Exception, match="weird"):
        cleaning.yield_group_to_code(df).collect()


def test_rare_categories_prefix_first(spark):
    df = spark.createDataFrame([("Trade: type 7",), ("Transport: type 1",), ("Business Entity Type 3",), ("Bank",), (None,), ("School",)], "ORGANIZATION_TYPE string")
    assert [r[0] for r in cleaning.group_rare_categories(df).collect()] == ["Trade", "Transport", "Business Entity", "Other", None, "School"]


def test_ext_source_all_missing(spark):
    df = spark.createDataFrame([(None, None), (0.5, None)], "a double, b double")
    from loanlens.functions.nulls import row_mean, row_sum
    assert [tuple(r) for r in df.select(row_mean(["a", "b"]), row_sum(["a", "b"])).collect()] == [(None, 0.0), (0.5, 0.5)]


def test_merge_fills_only_the_counts(spark):
    c = spark.createDataFrame([(1,), (2,)], "SK_ID_CURR long")
    p = spark.createDataFrame([(1, 3, "YES")], "SK_ID_CURR long, APPLICATION_COUNT_PREV long, HAD_DPD_PREV string")
    b = spark.createDataFrame([(2, 4, 1.0)], "SK_ID_CURR long, APPLICATION_COUNT_BUREAU long, SUM_AMT_DEBT_BUREAU double")
    got = {r.SK_ID_CURR: tuple(r)[1:] for r in clients.merge_history(c, p, b).collect()}
    assert got == {1: (3, "YES", 0, None), 2: (0, None, 4, 1.0)}


def test_key_coverage(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(2,), (2,), (9,), (None,)], "k long")
    assert tuple(clients.key_coverage(a, b, "k").first()) == (2, 1)


def reconcile_one(active, status, fact, update, snapshot):
    """The five rules applied to one row, straight from their statement."""
    month = update / 30.44
    older = snapshot is not None and month < snapshot
    newer = snapshot is not None and month > snapshot
    if active == "Active" and fact is not None:
        active, status = "Closed", "C"
    if active == "Active" and status == "C" and older:
        active = "Closed"
    if active == "Active" and status in ("C", "X", "UNKNOWN") and newer:
        status = "0"
    if active == "Closed" and status in "012345" and older:
        active = "Active"
    if active == "Closed" and status in "012345" and newer:
        status = "C"
    return active, status


def test_reconcile_every_state(spark):
    states = list(itertools.product(["Active", "Closed", "Sold"], ["0", "3", "5", "C", "X", "UNKNOWN"], [None, -5.0], [-300, -30], [None, -5, 0]))
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(states)],
                               "i int, CREDIT_ACTIVE string, CURRENT_STATUS string, DAYS_ENDDATE_FACT double, DAYS_CREDIT_UPDATE int, LAST_SNAPSHOT int")
    got = [(r.CREDIT_ACTIVE, r.CURRENT_STATUS) for r in bureau.reconcile_status(df).orderBy("i").collect()]
    assert got == [reconcile_one(*s) for s in states]


def test_impossible_credits_keep_missing(spark):
    df = spark.createDataFrame(
        [(-10, None, None, -5), (-10, -20.0, None, -5), (-10, None, -20.0, -5), (-10, None, None, 1), (-10, None, None, None), (-9000, None, None, -5001), (-3, None, None, -5)],
        "DAYS_CREDIT int, DAYS_CREDIT_ENDDATE double, DAYS_ENDDATE_FACT double, DAYS_CREDIT_UPDATE int")
    assert bureau.drop_impossible_credits(df).count() == 2


def test_missing_debt_counts_as_debt(spark, sf_dir):
    t = Lending(spark, sf_dir)
    one = t.bureau.filter("AMT_CREDIT_SUM_DEBT is null").limit(1).withColumn("LAST_SNAPSHOT", F.lit(None).cast("int")).withColumn(
        "LOAN_LENGTH", F.lit(None).cast("double"))
    for k in range(1, 6):
        one = one.withColumn(f"HAD_{k}_DPD", F.lit("UNKNOWN"))
    r = bureau.client_bureau_features(one).first()
    assert r.HAD_DEBT_BUREAU == "YES" and r.SUM_AMT_DEBT_BUREAU == 0 and r.HAD_1DPD_BUREAU == "NO"


def test_monthly_tables_use_hash_aggregation(spark, sf_dir):
    t = Lending(spark, sf_dir)
    for df in (previous.loan_pos_features(t.pos_cash, TIE), previous.loan_installment_features(t.installments),
               previous.loan_card_features(t.credit_card), bureau.credit_status_features(t.bureau_balance, TIE),
               previous.client_loan_features(t.loans())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "HashAggregate" in plan
