"""Column-expression helpers shared by the operators.

Everything here builds a ``Column`` (JVM-side, code-generated); nothing runs in
Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multiplier and modulus of the portable pseudo-random order
# (Knuth's multiplicative hash), identical in Spark and the DuckDB oracle.
HASH_MULTIPLIER = 2654435761
HASH_MODULUS = 4294967296

MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(38, 2)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def portable_hash(key: str | Column, seed: int = 0) -> Column:
    """``((key + seed) * 2654435761) mod 2**32`` without 64-bit overflow.

    The key is split into 16-bit halves so the products stay below 2**63 for any
    BIGINT key; for small keys the value equals the plain SQL expression
    ``((key + seed) * 2654435761) % 4294967296`` used by the oracle.
    """
    k = F.pmod(col(key).cast("long") + F.lit(seed), F.lit(HASH_MODULUS))
    hi = F.floor(k / F.lit(65536)).cast("long")
    lo = F.pmod(k, F.lit(65536))
    m = F.lit(HASH_MULTIPLIER)
    return F.pmod(F.pmod(hi * m, F.lit(65536)) * F.lit(65536) + lo * m, F.lit(HASH_MODULUS))


def r4(c: str | Column, digits: int = 4) -> Column:
    """Round a ratio / statistic for display and oracle comparison."""
    return F.round(col(c).cast("double"), digits)


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def money_sum(c: str | Column) -> Column:
    """Exact sum of money: DECIMAL in, DECIMAL(38,2) out (order cannot change it)."""
    return F.sum(col(c).cast(MONEY)).cast(MONEY_SUM)


def nan_to_null(c: str | Column) -> Column:
    """A double column whose NaN is null, as every statistic and imputation takes it."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL (pandas: NaN/inf) instead of raising under ANSI mode."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def exact_quantiles(c: str | Column, probs: Sequence[float]) -> Column:
    """Exact, linearly interpolated quantiles (pandas ``quantile`` / DuckDB ``quantile_cont``).

    Spark's ``percentile`` keeps a count per distinct value: memory grows with the
    number of distinct values of one group. ``approx_quantiles`` is the scale path.
    """
    return F.percentile(col(c).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))


def approx_quantiles(c: str | Column, probs: Sequence[float], accuracy: int = 10000) -> Column:
    return F.percentile_approx(col(c).cast("double"), [float(p) for p in probs], accuracy)


def numeric_columns(df: DataFrame, numeric_like: bool = False) -> list[str]:
    """Numeric feature names. ``numeric_like`` also counts bool and timestamps
    (the reference's "every non-object dtype" rule)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out.append(f.name)
        elif numeric_like and isinstance(f.dataType, (T.BooleanType, T.TimestampType,
                                                      T.TimestampNTZType, T.DateType)):
            out.append(f.name)
    return out


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

