"""Which column of a statement table plays which part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared categorical columns of the statement table.
CATEGORICAL_COLUMNS = (
    "B_30", "B_38", "D_114", "D_116", "D_117", "D_120",
    "D_126", "D_63", "D_64", "D_66", "D_68",
)
# Columns read as text; every other feature is a 32-bit float.
TEXT_COLUMNS = ("customer_ID", "D_63", "D_64")
# Seed and fold count shared by all models.
SEED = 42
FOLDS = 5

_TIE_BITS = 42


@dataclass(frozen=True)
class Roles:
    """Column roles. ``tie`` orders statements that share a date; ``day_grain`` says
    that dates carry no time of day, ``tie_bits`` how many bits a BIGINT ``tie`` needs at most."""

    key: str = "customer_ID"
    date: str = "S_2"
    tie: str | None = None
    day_grain: bool = False
    tie_bits: int = 63
    categoricals: tuple[str, ...] = CATEGORICAL_COLUMNS
    not_features: tuple[str, ...] = field(default=())

    def feature_columns(self, df: DataFrame) -> list[str]:
        skip = {self.key, self.date, self.tie, *self.not_features}
        return [c for c in df.columns if c not in skip]

    def categorical_columns(self, df: DataFrame) -> list[str]:
        present = set(self.feature_columns(df))
        return [c for c in self.categoricals if c in present]

    def numeric_columns(self, df: DataFrame) -> list[str]:
        cats = set(self.categorical_columns(df))
        return [c for c in self.feature_columns(df) if c not in cats]

    def order_columns(self) -> list[str]:
        return [self.date] + ([self.tie] if self.tie else [])

    def order_key(self, df: DataFrame) -> Column:
        """One sortable value per statement, a BIGINT wherever that is exact.

        A fixed-width key keeps ``min_by``/``max_by`` inside hash aggregation, about
        twice as fast here as a struct key, which forces a sort. Whole days with an
        integer tie column are packed into one BIGINT; a value that does not fit
        fails the query. Other types fall back to the struct.
        """
        date = F.col(self.date)
        dtype = df.schema[self.date].dataType
        if self.tie is None:
            if isinstance(dtype, T.DateType):
                return F.unix_date(date).cast("long")
            return F.unix_micros(date.cast("timestamp"))
        tie_type = df.schema[self.tie].dataType
        narrow = isinstance(tie_type, T.IntegralType) and not isinstance(tie_type, T.LongType)
        if self.day_grain and (narrow or self.tie_bits <= _TIE_BITS and isinstance(tie_type, T.LongType)):
            tie = F.col(self.tie).cast("long")
            if narrow:
                tie = tie + F.lit(1 << 31)  # from 0 on
            packed = F.shiftleft(F.unix_date(date.cast("date")).cast("long"), _TIE_BITS) + tie
            fits = tie.between(0, 2**_TIE_BITS - 1) & (F.date_trunc("day", date) == date)
            message = F.lit(f"{self.date}, {self.tie} do not fit the packed order key")
            return F.when(fits, packed).when(
                date.isNotNull() & tie.isNotNull(), F.raise_error(message).cast("long")
            )
        return F.when(date.isNotNull(), F.struct(date, F.col(self.tie)))
