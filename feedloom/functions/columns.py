"""Column helpers: all of them stay inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_SCALE = 1_000_000_000
FINE_SCALE = 1_000_000_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c, default: float | None = 0.0) -> Column:
    """Double, with text that does not parse, NaN and infinities replaced by ``default``."""
    v = col_(c).try_cast("double")
    v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def flag(c) -> Column:
    """1 where the numeric value is above zero, else 0."""
    return F.when(num(c) > 0, 1).otherwise(0)


def clip(c, low=None, high=None) -> Column:
    """Clamp without turning null into a bound."""
    c = col_(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def share(n, d) -> Column:
    """n / max(d, 1) in double."""
    return col_(n).cast("double") / F.greatest(col_(d).cast("double"), F.lit(1.0))


def fixed_sum(c, scale: int = LONG_SCALE) -> Column:
    """Sum rounded terms as integers.

    Integer addition has no order, so the result does not change with the
    partitioning or after a task retry, and rankings over it stay put.  The sum
    has 38 digits, so whole tables do not overflow it.
    """
    return F.sum(F.floor(col_(c) * float(scale) + 0.5).cast("decimal(28,0)")).cast("double") / float(scale)


def relative_lift(base, new) -> Column:
    base, new = col_(base), col_(new)
    return F.when(F.abs(base) >= 1e-12, (new - base) / base)


def ymd_to_date(c) -> Column:
    """YYYYMMDD integer to date, null when it is no date.

    Plain arithmetic: several times cheaper per row than parsing text.
    """
    n = col_(c).cast("int")
    y, m, d = F.floor(n / 10000).cast("int"), F.floor(n / 100).cast("int") % 100, n % 100
    month_ok = y.between(1, 9999) & m.between(1, 12)
    first = F.when(month_ok, F.make_date(y, m, F.lit(1)))
    return F.when(d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))


def date_to_ymd(c) -> Column:
    d = col_(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def days_between(reference, upload) -> Column:
    """Whole days, never below zero, null when either side is missing."""
    return clip(F.datediff(reference, upload), 0)


def log2p(c, plus: int = 1) -> Column:
    return F.log2(col_(c).cast("double") + F.lit(float(plus)))


# ------------------------------------------------------------------ arrays


def tail(arr, n: int) -> Column:
    """Last ``n`` elements; the whole array when it is shorter."""
    arr = col_(arr)
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), F.lit(n))


def left_pad(arr, n: int, fill) -> Column:
    arr = col_(arr)
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(arr), F.lit(0))), arr)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    a = col_(a)
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


# ----------------------------------------------------------------- hashing


def md5_key(*parts) -> Column:
    """Reproducible pseudo-random sort key: md5 of the parts joined by ':'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def hex_fraction(hex_col, start: int = 1, digits: int = 16) -> Column:
    """Hex digits read as a fraction in [0, 1)."""
    value = F.conv(F.substring(hex_col, start, digits), 16, 10)
    return value.cast("decimal(20,0)").cast("double") / F.lit(float(16**digits))


def md5_uniform(*parts) -> Column:
    return hex_fraction(md5_key(*parts))


def stable_id(namespace: str, raw) -> Column:
    """Integer text stays an integer; any other text hashes to [1e9, 2e9)."""
    text = col_(raw).cast("string")
    digest = F.md5(F.concat(F.lit(f"{namespace}:"), text).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.lit(1_000_000_000)
    return F.coalesce(F.trim(text).try_cast("bigint"), hashed + F.lit(1_000_000_000))


def user_key(raw) -> Column:
    text = col_(raw).cast("string")
    number = F.trim(text).try_cast("bigint")
    return F.coalesce(number.cast("string"), F.concat(F.lit("anon:"), text))


def event_millis(raw, now_ms) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to epoch milliseconds.

    Text without an offset is UTC; what cannot be read takes ``now_ms``.
    """
    text = F.trim(col_(raw).cast("string"))
    number = text.try_cast("double")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    # a bare date also takes the UTC offset, through midnight
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00+00:00"))).otherwise(zoned)
    iso = F.unix_millis(F.try_to_timestamp(zoned))
    seconds = F.when(number < 1e10, number * 1000.0).otherwise(number)
    return F.coalesce(seconds.cast("bigint"), iso, col_(now_ms).cast("bigint"))
