"""Column functions over turned segments: metrics, units, labels, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from swarf.params import DEFAULT

PI = math.pi


def wall_thickness(od: Column, bore: Column) -> Column:
    """Half the difference with a bore, half the diameter without, 0 without an outside."""
    return F.when((od > 0) & (bore > 0), (od - bore) / 2).when(od > 0, od / 2).otherwise(F.lit(0.0))


def ring(od: Column, bore: Column) -> Column:
    """Area of an end face."""
    return F.lit(PI) * (od / 2 * (od / 2) - bore / 2 * (bore / 2))


def volume(length: Column, od: Column, bore: Column) -> Column:
    return F.lit(PI) * length * (od / 2 * (od / 2) - bore / 2 * (bore / 2))


def mantle(length: Column, diameter: Column) -> Column:
    return F.when(diameter > 0, F.lit(PI) * diameter * length).otherwise(F.lit(0.0))


def shoulder(one: Column, other: Column) -> Column:
    """Area of the ring between two diameters."""
    return F.lit(PI) * F.abs(one / 2 * (one / 2) - other / 2 * (other / 2))


def to_inches(x: Column, units: Column) -> Column:
    return F.when(units == "mm", x / DEFAULT.mm_per_inch).otherwise(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def as_number(x: Column) -> Column:
    """A double, or null for whatever is none."""
    return x.try_cast("double")


def ceil_to_step(x: Column, step: float) -> Column:
    """Up to a whole step, in decimals, so that whole steps stay."""
    return (F.ceil(x.cast("string").cast("decimal(38,18)") / F.lit(str(step)).cast("decimal(6,3)")) * F.lit(str(step)).cast("decimal(6,3)")).cast("double")


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / F.lit(1000.0)


def to_solid(radius: Column, axial: Column) -> Column:
    """The point of a profile in space: the radius along x, the place on the axis along z, in the plane y = 0."""
    return F.struct(radius.alias("x"), F.lit(0.0).alias("y"), axial.alias("z"))


def to_profile(x: Column, z: Column) -> Column:
    """Back from the plane y = 0 to the profile."""
    return F.struct(x.alias("radius"), z.alias("axial"))


def weight(vol: Column, g_cm3: Column, lb_in3: Column) -> Column:
    """Pounds; the density in pounds wins; null without one."""
    return vol * F.coalesce(lb_in3, g_cm3 * DEFAULT.lb_per_in3)


def confidence_label(x: Column, high: float = 0.8, medium: float = 0.6) -> Column:
    return F.when(x.isNull(), "Unknown").when(x >= high, "High").when(x >= medium, "Medium").otherwise("Low")


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%.0fms", ms)).otherwise(F.format_string("%.2fs", ms / 1000))
