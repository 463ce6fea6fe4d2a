"""Severity labels and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import GAUGE_LABELS, RETURN_PERIOD_TIERS, SEVERITIES
from floodspark.functions.parsing import stripped


def cases(subject: Column, mapping: dict, otherwise: Column) -> Column:
    """CASE over constant keys; stays inside code generation, unlike a map lookup."""
    start, *rest = mapping.items()
    whens = reduce(
        lambda acc, kv: acc.when(subject == F.lit(kv[0]), F.lit(kv[1])),
        rest,
        F.when(subject == F.lit(start[0]), F.lit(start[1])),
    )
    return whens.otherwise(otherwise)


def severity_rank(label: Column) -> Column:
    """0..3 for the known labels in any case, -1 for anything else."""
    return cases(F.lower(label), {s: i for i, s in enumerate(SEVERITIES)}, F.lit(-1))


def severity_of_rank(rank: Column) -> Column:
    """Label of a rank as the builds see it: unknown is the empty string."""
    return cases(rank, dict(enumerate(SEVERITIES)), F.lit(""))


def shown_severity_of_rank(rank: Column) -> Column:
    """Label of a rank as the serving side sees it: ``none`` is unknown there as well."""
    return F.when(rank > 0, severity_of_rank(rank)).otherwise(F.lit(""))


def return_period_severity(years: Column, tiers=RETURN_PERIOD_TIERS) -> Column:
    """Severity of a whole-year return period, NULL below the lowest tier."""
    ordered = sorted(tiers, reverse=True)
    whens = F.when(years >= ordered[0][0], F.lit(ordered[0][1]))
    for years_from, label in ordered[1:]:
        whens = whens.when(years >= years_from, F.lit(label))
    return whens


def gauge_severity(raw: Column, labels=None) -> Column:
    """Severity of a raw gauge label, NULL for labels that raise no alert."""
    return cases(F.upper(stripped(raw)), labels or GAUGE_LABELS, F.lit(None).cast("string"))
