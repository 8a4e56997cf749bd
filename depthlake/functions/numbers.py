"""Numbers and depths as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Number grammar of depth texts (grouping by space, NBSP, narrow NBSP, apostrophes).
NUMBER = r"(?:\d(?:[\d\s\u00a0\u202f'’]*\d)?(?:[.,]\d+){0,2}|[.,]\d+)"
DECIMAL = "decimal(30,10)"
MAX_FLOAT = 1.7976931348623157e308


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` (a lambda variable)."""
    return F.get(F.transform(F.array(value), use), 0)


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def parse_decimal(c: Column) -> Column:
    """Locale-tolerant decimal: the last of ``.`` and ``,`` is the decimal mark (F1)."""
    text = F.replace(F.trim(c.cast("string")), F.lit("−"), F.lit("-"))
    token = F.regexp_extract(text, "[-+]?" + NUMBER, 0)
    bare = F.regexp_replace(token, "[ \\u00a0\\u202f'’+]", "")
    last_mark_only = F.translate(F.regexp_replace(bare, "[.,](?=.*[.,])", ""), ",", ".")
    return last_mark_only.try_cast(DECIMAL)


def decimal_tokens(c: Column) -> Column:
    """All numeric tokens of a text, decimals kept whole (F2)."""
    return F.regexp_extract_all(unify_dashes(F.coalesce(c, F.lit(""))), F.lit(f"({NUMBER})"), F.lit(1))


def unify_dashes(c: Column) -> Column:
    return F.translate(c, "−–—", "---")


def to_cm(c: Column) -> Column:
    """Metres to whole centimetres, half-up on the decimal value."""
    return F.round(c.cast("decimal(28,8)") * 100, 0).cast("bigint")


def from_cm(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def normalize_depth(c: Column) -> Column:
    return from_cm(to_cm(c))


def format_depth(cm: Column) -> Column:
    """Centimetres as metres text without trailing zeros."""
    return F.regexp_replace(from_cm(cm).cast("string"), r"\.?0+$", "")


def as_number(c: Column) -> Column:
    """Cell text to decimal; formulas are not values."""
    return F.when(~F.ltrim(c.cast("string")).startswith("="), parse_decimal(c))


def date_serial(c: Column) -> Column:
    """Spreadsheet day number of a date that should have been a depth."""
    return F.datediff(c, F.lit("1899-12-30").cast("date"))


def first_number(c: Column) -> Column:
    """First plain number after comma to dot, the importer's looser reading."""
    text = F.translate(F.trim(c), ", ", ".")
    return nullif_blank(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)).try_cast("double")


def parse_interval(c: Column) -> Column:
    """First two numbers of a cell: struct<top, base>, NULLs when fewer."""
    def ends(tokens):
        both = F.size(tokens) >= 2
        return F.struct(
            F.when(both, as_number(F.get(tokens, 0))).alias("top"),
            F.when(both, as_number(F.get(tokens, 1))).alias("base"))

    return let(decimal_tokens(F.trim(F.regexp_replace(c, r"\s+", " "))), ends)


def depth_label(c: Column) -> Column:
    """Recognised depth label to a number with letter repair and six-digit compaction."""
    text = F.translate(F.trim(c), "OoIl", "0011")
    token = F.trim(F.regexp_replace(text, r"^[\[\](){}|:;]+|[\[\](){}|:;]+$", ""))
    token = F.trim(F.regexp_replace(token, r"(?iu)\s*[mм]\s*$", ""))
    value = F.when(
        token.rlike(r"^(?:\d[\d.,\s\u00a0\u202f'’]*|[.,]\d+)$"), parse_decimal(token)).cast("double")
    digits = F.regexp_replace(token, r"\D", "")
    packed = F.when(
        F.length(digits) == 6,
        F.concat(F.substring(digits, 1, 4), F.lit("."), F.substring(digits, 5, 2)).try_cast("double"))
    return F.when((value >= 0) & (value < 100000), value).otherwise(packed)


def round_five(c: Column) -> Column:
    """Nearest multiple of five, ties to even."""
    return (F.rint(c / 5.0) * 5).cast("bigint")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def thickness_matches(top_cm: Column, base_cm: Column, thickness_cm: Column) -> Column:
    """Declared thickness equals the span to the centimetre."""
    return (base_cm > top_cm) & (thickness_cm == base_cm - top_cm)


def thickness_differs(span: Column, thickness: Column, floor: float = 0.01, share: float = 0.02) -> Column:
    """Importer's looser warning: off by more than 1 cm and 2 %."""
    return F.abs(thickness - span) > F.greatest(F.lit(floor), F.abs(span) * share)


def finite(c: Column) -> Column:
    """Number or NULL; NaN and infinities are NULL."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) <= MAX_FLOAT), value)


def finite_int(c: Column) -> Column:
    return finite(c).cast("bigint")


def is_ruler(values: Column, least: int = 4) -> Column:
    """Row is the printed column-number ruler 1, 2, 3, ... (F22); ``values`` are cell texts."""
    present = F.filter(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    one = F.coalesce(as_number(F.get(present, 0)) == 1, F.lit(False))  # spares most rows the reading of all their cells
    numbers = F.transform(present, lambda v: as_number(v))
    right = F.transform(F.sequence(F.lit(1), F.size(present)), lambda i: i.cast(DECIMAL))
    return F.when((F.size(present) >= least) & one, F.coalesce(numbers == right, F.lit(False))).otherwise(F.lit(False))


def is_two_digit_row(values: Column) -> Column:
    """Looser ruler test: every present cell is one or two digits."""
    present = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    return (F.size(present) > 0) & F.forall(present, lambda v: v.rlike(r"^\d{1,2}$"))
