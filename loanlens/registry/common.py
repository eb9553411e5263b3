"""Shared by the registered queries: lending tables of a folder and rounding for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.plans import features
from loanlens.sources.tables import spread
from loanlens.sources.views import table, view

TIE = "ROW_TIEBREAK"
DIGITS = 6
NUDGE = 1e-10


class Lending:
    """The lending tables and the main intermediate results of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        self.__dict__[name] = view(self.raw, name)  # read each table's footer once
        return self.__dict__[name]

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = table(self.spark, self.sf_dir, name)
        return self._raw[name]

    def loans(self) -> DataFrame:
        return features.clean_loans(self.prev_apps, self.pos_cash, self.installments, self.credit_card, TIE)

    def previous_features(self) -> DataFrame:
        return features.previous_features(self.prev_apps, self.pos_cash, self.installments, self.credit_card, TIE)

    def credits(self) -> DataFrame:
        return features.clean_credits(self.bureau, self.bureau_balance, TIE)

    def bureau_features(self) -> DataFrame:
        return features.bureau_features(self.bureau, self.bureau_balance, TIE)

    def matrix(self) -> DataFrame:
        return features.client_matrix(
            spread(self.clients, "SK_ID_CURR"),
            features.previous_feature_table(self.previous_features()),
            features.bureau_feature_table(self.bureau_features()),
        )


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double, as the order of summation differs between engines.

    The nudge moves decimal ties (a mean of 32 prices ends in a 5 one digit further on) off the
    rounding boundary, where the last bit would decide; adding 0 drops a negative zero.
    """
    return df.select([
        (F.round(F.col(f.name) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def rsql(**columns: str) -> str:
    """Select-list text that rounds each expression to the comparison precision."""
    return ",\n ".join(f"round(cast({e} as double) + {NUDGE!r}, {DIGITS}) + 0e0 as {name}" for name, e in columns.items())
