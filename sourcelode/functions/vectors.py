"""Vector columns: checks, distance, pooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_ok(vector: Column, dim: int) -> Column:
    """True for a vector of exactly ``dim`` real numbers."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce((F.size(vector) == dim) & real, F.lit(False))


def l2_squared(left: Column, right: Column) -> Column:
    """Squared distance, summed in double from the first dimension on."""
    gaps = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x.cast("double"))


def pool_window(flat: Column, k: Column, dim: int) -> Column:
    """Mean of each run of ``k`` neighbouring slots of the joined chunk vectors."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (_total(F.slice(flat, i * k + F.lit(1), k)) / k).cast("float"),
    )


def pool_mean(flat: Column, k: Column, dim: int) -> Column:
    """Mean of each dimension over the ``k`` chunks."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(dim)),
        lambda j: (
            F.aggregate(
                F.sequence(F.lit(0), k - F.lit(1)),
                F.lit(0.0),
                lambda total, c: total + F.element_at(flat, c * F.lit(dim) + j).cast("double"),
            )
            / k
        ).cast("float"),
    )


def exact_part(x: Column) -> list[Column]:
    """A float as a whole number of units: ``scale, units`` with x = units * 2^(scale - 24).

    Scales are multiples of eight, so values of like size share one. Units are below 2^34: a ``sum``
    of them by scale is exact for 2^29 values, in any order and however it is merged.
    """
    wide = x.cast("double")
    scale = F.when(wide == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(wide)) / 8) * 8).cast("int")
    units = (wide * F.pow(F.lit(2.0), 24 - scale)).cast("long")
    return [scale.alias("scale"), units.alias("units")]


def exact_total(sums: Column) -> Column:
    """The double that sums of ``exact_part`` by scale stand for, added from the greatest scale down."""
    return F.aggregate(
        F.reverse(F.array_sort(sums)),
        F.lit(0.0),
        lambda total, s: total + s["units"].cast("double") * F.pow(F.lit(2.0), s["scale"] - 24),
    )
