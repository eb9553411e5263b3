"""From source tables to the client feature table.

The order of the steps is part of the result: placeholders become null before missing texts become
'UNKNOWN', and that happens before the yield recode, the fills of unapproved loans and the client
aggregation, all of which test for 'UNKNOWN' or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from loanlens.operators import bureau as bureau_ops
from loanlens.operators import cleaning, clients, previous


def clean_loans(
    prev_apps: DataFrame, pos_cash: DataFrame, installments: DataFrame, credit_card: DataFrame, tie: str | None = None
) -> DataFrame:
    """Previous applications, cleaned and with their loan-level features."""
    loans = cleaning.last_application_per_contract(prev_apps)
    loans = previous.loan_features(loans, pos_cash, installments, credit_card, tie)
    loans = cleaning.sentinels_to_null(loans)
    loans = loans.drop(*cleaning.SPARSE_COLUMNS)
    loans = cleaning.unknown_texts(loans)
    loans = cleaning.yield_group_to_code(loans)
    loans = cleaning.fill_amounts(loans)
    loans = loans.drop(*cleaning.DUE_DAY_COLUMNS)
    return previous.fill_unapproved(loans)


def previous_features(
    prev_apps: DataFrame, pos_cash: DataFrame, installments: DataFrame, credit_card: DataFrame, tie: str | None = None
) -> DataFrame:
    """Client-level features of previous loans, signs as they come out of the aggregation."""
    loans = clean_loans(prev_apps, pos_cash, installments, credit_card, tie)
    return previous.client_previous_features(loans, pos_cash, credit_card, installments)


def clean_credits(bureau: DataFrame, bureau_balance: DataFrame, tie: str | None = None) -> DataFrame:
    """Bureau credits, cleaned and reconciled with their monthly status."""
    credits = bureau_ops.add_credit_status(bureau, bureau_balance, tie)
    credits = bureau_ops.drop_impossible_credits(credits)
    credits = bureau_ops.clamp_credits(credits)
    credits = cleaning.unknown_texts(credits)
    credits = bureau_ops.cap_end_date(credits)
    credits = bureau_ops.reconcile_status(credits)
    return bureau_ops.add_credit_length(credits)


def bureau_features(bureau: DataFrame, bureau_balance: DataFrame, tie: str | None = None) -> DataFrame:
    """Client-level features of bureau credits, signs as they come out of the aggregation."""
    return bureau_ops.client_bureau_features(clean_credits(bureau, bureau_balance, tie))


def previous_feature_table(prev_features: DataFrame) -> DataFrame:
    """The form that is written: negative offsets turned positive."""
    return cleaning.flip_signs(prev_features, cleaning.PREV_NEGATIVE)


def bureau_feature_table(features: DataFrame) -> DataFrame:
    return cleaning.flip_signs(features, cleaning.BUREAU_NEGATIVE)


def client_matrix(client_table: DataFrame, prev_table: DataFrame, bureau_table: DataFrame) -> DataFrame:
    """Client table with derived columns and both history tables; raw enquiry and circle counts dropped."""
    derived = clients.client_features(cleaning.group_rare_categories(client_table))
    return clients.merge_history(derived.drop(*clients.ENQUIRIES, *clients.SURROUNDINGS), prev_table, bureau_table)
