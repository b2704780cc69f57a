"""Row-wise expressions.  Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: label given to a missing categorical value when nulls are kept
# as an ordinary label (Python's ``str(float('nan'))``).
NULL_LABEL = "nan"


def qcol(name: str) -> Column:
    """Column by name; safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL, so that every later aggregate sees a single kind of missing."""
    return F.nanvl(c, F.lit(None).cast("double"))


# Spark's cast also takes Java's own spellings ('12f', '1d', '0x1p3'), which are not numbers elsewhere.
JAVA_ONLY_NUMBER = r"[0-9.][dDfF]\s*$|[xX]"
WHOLE_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


def text_number(c: Column) -> Column:
    """Double of a text (sign, digits, point, exponent; infinity and NaN), NULL where it is not a number."""
    return F.when(~c.rlike(JAVA_ONLY_NUMBER), c.try_cast("double"))


def is_not_number(c: Column) -> Column:
    """True for a text that is neither NULL nor a number."""
    return c.isNotNull() & text_number(c).isNull()


def to_double(c: Column, dtype: T.DataType | None = None) -> Column:
    """Cast to double; NaN becomes NULL.  A non-numeric string raises (ANSI)."""
    if isinstance(dtype, T.BooleanType):
        c = c.cast("int")
    if isinstance(dtype, T.StringType):
        c = F.when(is_not_number(c), F.raise_error(F.concat(F.lit("not a number: "), c)).cast("double")) \
            .otherwise(text_number(c))
    return nan_to_null(c.cast("double"))


def to_whole(c: Column, dtype: T.DataType | None = None) -> Column:
    """Cast to bigint; a text of digits keeps all of them, other numbers lose their fraction."""
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(WHOLE_PATTERN), F.trim(c).cast("bigint")).otherwise(to_double(c, dtype).cast("bigint"))
    return c.cast("bigint")


def double_text(d: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 up to 1e16, else with an exponent of two digits or more.

    Digits and exponent are those of Spark's own text; only the notation changes.
    """
    s = d.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.ltrim(s, F.lit("-"))
    mantissa = F.substring_index(body, "E", 1)
    exponent = F.when(body.contains("E"), F.substring_index(body, "E", -1).cast("int")).otherwise(F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    part = F.when(part == "0", F.lit("")).otherwise(part)
    digits = F.concat(whole, part)                      # one digit before the point whenever there is an exponent
    after = F.length(digits) - 1
    plain_big = F.when(after <= exponent, F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))) \
        .otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."),
                            F.substring(digits, exponent + 2, F.length(digits))))
    plain_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")),
                          F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"))
    text = F.when(~body.contains("E"), body).when((exponent > 0) & (exponent < 16), plain_big) \
        .when((exponent < 0) & (exponent >= -4), plain_small).otherwise(scientific)
    return F.when(F.isnan(d), F.lit(NULL_LABEL)).when(F.abs(d) == F.lit(float("inf")), F.concat(sign, F.lit("inf"))) \
        .otherwise(F.concat(sign, text))


def to_label(c: Column, dtype: T.DataType | None = None, nulls_as_label: bool = False) -> Column:
    """Cast a value to its categorical label (a string).

    Booleans become 'True'/'False' and doubles ``double_text`` (Python spellings).
    """
    if isinstance(dtype, T.BooleanType):
        s = F.initcap(c.cast("string"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        s = double_text(c.cast("double"))
    else:
        s = c.cast("string")
    if nulls_as_label:
        s = F.coalesce(s, F.lit(NULL_LABEL))
    return s


def clip_expr(c: Column, lower: float | None, upper: float | None) -> Column:
    """Clip to [lower, upper]; either bound may be None; NULL stays NULL.

    ``greatest``/``least`` skip NULL inputs, so an unguarded clip would turn a
    NULL into a bound: the ``when`` guard keeps it NULL.
    """
    out = c
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is None and lower is None:
        return c
    return F.when(c.isNotNull(), out)


def one_hot_name(col: str, category: str) -> str:
    return f"{col}_{category}"


def format_fixed(c: Column, decimals: int = 4, parts: tuple | None = None) -> Column:
    """Text of a double with ``decimals`` decimals, rounded like C / Python
    ``'%.{n}f'``: from the exact binary value, ties (exactly representable
    halves) to even.  Spark's ``format_string`` rounds the shortest decimal
    form half-up instead (2.15625 -> '2.1563' where Python writes '2.1562').

    x * 10^n is split into p + e exactly (Dekker's product with Veltkamp
    splitting, plain double arithmetic), which decides the rare cases where p
    lands on a .5 boundary.  From 2^42 on, whole part and fraction are written
    apart, both exactly; from 2^63 on (and for NaN and infinities) ``format_string``
    writes the shortest digits, padded with zeros.
    """
    scale = float(10 ** decimals)
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    a = F.abs(x)
    if parts is None:
        p = a * F.lit(scale)
        split = F.lit(134217729.0) * a            # 2^27 + 1
        ah = split - (split - a)
        al = a - ah
    else:                                         # precomputed (p, ah, al) columns
        p, ah, al = parts
    err = (ah * F.lit(scale) - p) + al * F.lit(scale)   # exact: a * scale = p + err
    fl = F.floor(p).cast("double")
    frac = p - fl
    up = F.when(frac > 0.5, True).when(frac < 0.5, False) \
        .when(err > 0, True).when(err < 0, False) \
        .otherwise(F.pmod(fl, F.lit(2.0)) == 1.0)          # exact tie: to even
    units = (fl + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))).cast("bigint")
    u = units.cast("string")
    digits = F.when(F.length(u) <= decimals, F.lpad(u, decimals + 1, "0")).otherwise(u)  # lpad would truncate
    int_len = F.length(digits) - F.lit(decimals)
    int_txt = digits.substr(F.lit(1), int_len)
    frac_txt = digits.substr(int_len + F.lit(1), F.lit(decimals))
    # C keeps the sign of negatives that round to zero, and of -0.0
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, int_txt, F.lit("."), frac_txt) if decimals > 0 else F.concat(sign, int_txt)
    # from 2**42 on, the fraction has at most 10 bits, so it times 10**decimals is exact
    w = F.floor(a)
    fu = (a - w.cast("double")) * F.lit(scale)
    fl2 = F.floor(fu).cast("double")
    half = fu - fl2
    tail = (fl2 + F.when((half > 0.5) | ((half == 0.5) & (F.pmod(fl2, F.lit(2.0)) == 1.0)), F.lit(1.0))
            .otherwise(F.lit(0.0))).cast("bigint")
    carry = F.when(tail >= F.lit(int(scale)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    large = F.concat(sign, (w + carry).cast("string"))
    if decimals > 0:
        large = F.concat(large, F.lit("."), F.lpad(F.pmod(tail, F.lit(int(scale))).cast("string"), decimals, "0"))
    return F.when(x.isNull(), F.lit(None).cast("string")) \
        .when(a < F.lit(float(2 ** 42)), exact).when(a < F.lit(float(2 ** 63)), large) \
        .otherwise(F.format_string(f"%.{decimals}f", x))
