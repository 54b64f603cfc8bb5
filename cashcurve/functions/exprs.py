"""H1-H9: the scalar building blocks every operator shares.

All are plain Column expressions (JVM side, inside whole-stage codegen); no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(19, 4)
RATE = DecimalType(19, 6)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Money column as DECIMAL(19,4) (HALF_UP when narrowing, as PostgreSQL NUMERIC)."""
    return col_(c).cast(MONEY)


def dbl(c: Column | str) -> Column:
    """Output edge (A6): decimals leave the engine as double, like the API's float()."""
    return col_(c).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den for decimal sums (V3): cast both to double *before* dividing.

    Decimal/decimal in Spark keeps only 6 fractional digits, which moves
    break-even figures by cents; dividing doubles matches the exact value to
    ~15 significant digits.  A zero or NULL denominator gives NULL (NULLIF).
    """
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def first_of_month(c: Column | str) -> Column:
    """M5 / H4: DATE_TRUNC('month', x)::date (``trunc`` keeps DateType, V12)."""
    return F.trunc(F.to_date(col_(c)), "MM")


def month_from_text(c: Column | str) -> Column:
    """TO_DATE(x || '-01'): 'YYYY-MM' text to the first of that month (NULL if bad)."""
    return F.try_to_date(F.concat(col_(c), F.lit("-01")), "yyyy-MM-dd")


def clamp(n: int, lo: int, hi: int, default: int) -> int:
    """H3: max(lo, min(n, hi)) on a request argument; None -> default."""
    if n is None:
        n = default
    return max(lo, min(int(n), hi))


def one_decimal(c: Column | str) -> Column:
    """Python's f"{x:.1f}" (V7): format_number rounds like it on observed values; drop separators."""
    return F.translate(F.format_number(col_(c), 1), ",", "")


def zero_as_null(c: Column | str) -> Column:
    """Stored zeros that the reference treats as 'absent' (falsy) become NULL."""
    return F.nullif(col_(c), F.lit(0))


def round_dp(c: Column | str, d: int) -> Column:
    """ROUND(double, d) as round-half-away-from-zero of x * 10^d, then / 10^d.

    Spark's ``round`` on a double rounds the shortest decimal text of the value
    (5123.235 -> 5123.24) although the binary value is below the tie; Python's
    ``round`` and DuckDB's ROUND both give 5123.23.  Scaling first keeps the
    binary value: rounding a double to 0 places is exact, so this agrees with
    the other engines except where the scaling itself rounds onto a tie.
    """
    k = float(10 ** d)
    return F.round(col_(c) * k, 0) / k


def round_even_dp(c: Column | str, d: int) -> Column:
    """Python's round(x, d): half-to-even, for metrics the reference computes in Python.

    Same scaling as ``round_dp`` (so it agrees with DuckDB's ``round_even``);
    exact binary ties such as 103.125 go to the even neighbour (103.12).
    """
    k = float(10 ** d)
    return F.bround(col_(c) * k, 0) / k
