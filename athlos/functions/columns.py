"""Column-expression helpers. All of them build built-in Catalyst expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it as the reference's statistics skip missing values."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clip_keep_null(c: str | Column, lo, hi) -> Column:
    """Bound ``c`` to [lo, hi]; a NULL stays NULL (``greatest``/``least`` alone would turn it into a bound).

    A NULL bound leaves that side open, as a missing quantile of an all-missing column does.
    """
    c = col(c)
    lo_c = F.lit(lo).cast("double") if not isinstance(lo, Column) else lo
    hi_c = F.lit(hi).cast("double") if not isinstance(hi, Column) else hi
    bounded = F.least(F.greatest(c, F.coalesce(lo_c, c)), F.coalesce(hi_c, c))
    return F.when(c.isNotNull(), bounded)


def round6(c: str | Column) -> Column:
    """Doubles leave our plans rounded to 6 places, so last-bit differences between engines do not show."""
    return F.round(col(c), 6)


def null_count(columns: Sequence[str]) -> Column:
    """Number of NULL cells among ``columns`` in a row."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def ordinal_code(c: str | Column, values: Sequence[str], default: int | None = None) -> Column:
    """Position of the value in ``values`` (0-based); unmapped → ``default`` (NULL if None)."""
    c = col(c)
    out = None
    for i, v in enumerate(values):
        out = (F.when(c == v, F.lit(i)) if out is None else out.when(c == v, F.lit(i)))
    return out.otherwise(F.lit(default)) if default is not None else out


def last_set_flag(flags: Mapping[str, str], default: str) -> Column:
    """Category from 0/1 flag columns: the value of the **last** flag equal to 1 wins, else ``default``.

    Missing flags count as not set. Built as a ``when`` chain in reverse flag order, because a chain is
    first-match.
    """
    out = None
    for flag, value in reversed(list(flags.items())):
        cond = F.coalesce(F.col(flag).cast("int"), F.lit(0)) == 1
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def band(c: str | Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """``names[i]`` for the first cut with ``c >= cut``; the last name below all cuts; NULL stays NULL."""
    c = col(c)
    out = None
    for cut, name in zip(cuts, names):
        cond = c >= F.lit(float(cut))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(c.isNotNull(), out.otherwise(F.lit(names[len(cuts)])))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def composite(parts: Sequence[str | Column], sep: str, missing: str = "?") -> Column:
    """Join parts with ``sep``; a NULL part becomes ``missing`` so parts never shift (unlike ``concat_ws``)."""
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.coalesce(col(p).cast("string"), F.lit(missing)))
    return F.concat(*pieces)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)
