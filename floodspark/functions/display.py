"""Text shown to a reader: links, labels, rounded and compact numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import (
    GAUGE_LINK, GAUGE_LINK_ID, GAUGE_MODEL, MODEL_LABELS, NO_VALUE, RIVER_LINK, RIVER_MODEL,
)
from floodspark.functions.parsing import is_finite
from floodspark.functions.severity import cases


def _tenths_residual(x: Column, twentieths: Column) -> Column:
    """Exact sign of ``20 * x - twentieths`` for a binary double (both products are exact)."""
    return (x * 16 - twentieths) + x * 4


def round_half_even_tenth(x: Column) -> Column:
    """One decimal, judged on the exact binary value; true ties go to the even tenth."""
    low = F.floor(x * 10)
    residual = _tenths_residual(x, (low * 2 + 1).cast("double"))
    up = (residual > 0) | ((residual == 0) & (low % 2 != 0))
    tenths = low + F.when(up, 1).otherwise(0)
    # A double at or above 2^49 has no tenths left to round.
    return F.when(F.abs(x) >= F.lit(2.0**49), x).otherwise(tenths / F.lit(10.0))


def round_half_even(x: Column) -> Column:
    """Whole number, ties to even."""
    return F.rint(x)


def _one_decimal_text(x: Column) -> Column:
    """Non-negative number at one decimal, ties up on the exact binary value, ``.0`` dropped."""
    low = F.floor(x * 10)
    up = _tenths_residual(x, (low * 2 + 1).cast("double")) >= 0
    tenths = low + F.when(up, 1).otherwise(0)
    whole = F.floor(tenths / 10).cast("string")
    return F.when(tenths % 10 == 0, whole).otherwise(
        F.concat(whole, F.lit("."), (tenths % 10).cast("string"))
    )


def compact_count(n: Column) -> Column:
    """``8181280`` -> ``8.2M``; no usable number -> a dash."""
    x = n.cast("double")
    return (
        F.when(~is_finite(x), F.lit(NO_VALUE))
        .when(x >= 1e9, F.concat(_one_decimal_text(x / 1e9), F.lit("B")))
        .when(x >= 1e6, F.concat(_one_decimal_text(x / 1e6), F.lit("M")))
        .when(x >= 1e3, F.concat(_one_decimal_text(x / 1e3), F.lit("k")))
        # Below a thousand: nearest whole number, halves up, grouped by commas.
        .otherwise(F.format_number(F.floor(x + 0.5), 0))
    )


def square_km(square_m: Column) -> Column:
    return square_m / F.lit(1e6)


def plain_number(x: Column) -> Column:
    """Shortest decimal text of a double, without a trailing ``.0`` and without an exponent for
    the coordinate range."""
    # Two scales, so that neither small fractions nor large numbers leave the decimal range.
    digits = F.coalesce(x.try_cast("decimal(38,24)"), x.try_cast("decimal(38,14)")).cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "\\.$", "")
    short = F.regexp_replace(x.cast("string"), "\\.0E", "E")
    return (
        F.when(x == 0, F.lit("0"))
        .when(~is_finite(x), x.cast("string"))
        .when(F.abs(x) < 1e-6, F.regexp_replace(short, "E", "e"))
        .when(F.abs(x) >= 1e21, F.regexp_replace(short, "E", "e+"))
        .otherwise(trimmed)
    )


def url_component(text: Column) -> Column:
    """Percent-encoding that leaves ``A-Z a-z 0-9 - _ . ! ~ * ' ( )`` alone."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def _fill(template: str, **values: Column) -> Column:
    """Concatenation of a ``{name}`` template with columns."""
    pieces, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        pieces += [F.lit(head), values[name]]
    return F.concat(*pieces, F.lit(rest))


def deep_link(
    model: Column, lat: Column, lon: Column, river_id: Column, river: tuple[str, str] = (RIVER_MODEL, RIVER_LINK),
    gauge: tuple[str, str, str] = (GAUGE_MODEL, GAUGE_LINK, GAUGE_LINK_ID),
) -> Column:
    """Link of one forecast into its source application; NULL without a finite coordinate.

    ``river`` and ``gauge`` give model id and link pattern, ``gauge`` also the pattern of its id part.
    """
    where = {"lat": plain_number(lat), "lon": plain_number(lon)}
    gauge_page = _fill(gauge[1], **where)
    gauge_suffix = F.when(
        F.coalesce(river_id, F.lit("")) != "", _fill(gauge[2], id=url_component(river_id))
    ).otherwise(F.lit(""))
    usable = is_finite(lat) & is_finite(lon)
    return F.when(usable & (F.lower(model) == river[0]), _fill(river[1], **where)).when(
        usable & (F.lower(model) == gauge[0]), F.concat(gauge_page, gauge_suffix)
    )


def model_label(model: Column, labels: dict[str, str] | None = None) -> Column:
    """Display name: the given ones, else underscores to blanks and every word capitalised."""
    words = F.split(
        F.replace(model, F.lit("_"), F.lit(" ")), "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
    )
    capitals = F.transform(
        words,
        lambda w: F.when(
            w.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
        ).otherwise(w),
    )
    return cases(model, labels or MODEL_LABELS, F.array_join(capitals, ""))


def value_text(field: str, value: Column) -> Column:
    """Text of one detail field; unit suffixes for the two numeric ones, dash for no value."""
    suffix = {"returnPeriodYr": "-year", "peakDischargeCms": " m³/s"}.get(field, "")
    return F.when(value.isNull() | (value == ""), F.lit(NO_VALUE)).otherwise(
        F.concat(value, F.lit(suffix))
    )


def agreement_label(models: Column) -> Column:
    n = F.size(models)
    return F.when(n >= 2, F.concat(n.cast("string"), F.lit(" models agree"))).otherwise(
        F.lit("Single model")
    )


def zoom_resolution(zoom: Column, resolutions, first_zoom: int, step: int) -> Column:
    """Last resolution whose start zoom is reached, else the first."""
    ordered = sorted(resolutions)
    # Clamped before it becomes an integer: no zoom is too large.
    reached = F.floor((zoom.cast("double") - F.lit(first_zoom)) / F.lit(step))
    position = F.greatest(F.lit(0), F.least(F.lit(len(ordered) - 1), reached)).cast("int")
    return F.when(zoom.isNotNull(), F.get(F.array(*[F.lit(r) for r in ordered]), position))
