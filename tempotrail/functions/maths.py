"""Number functions: conversions, scales, easing, lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: medal limits in seconds by era and sex, long race
MEDALS = {("pre", "M"): 34_199, ("pre", "F"): 39_599, ("post", "M"): 35_999, ("post", "F"): 41_759}


def inverse(x: Column) -> Column:
    """Pace of a speed and speed of a pace."""
    return F.when(x > 0, 3600.0 / x)


def relative_width(value: Column, largest: Column) -> Column:
    return F.when((value >= 0) & (largest > 0), F.least(F.lit(100.0), value / largest * 100)).otherwise(F.lit(0.0))


def bar_height(n: Column, largest: Column, plot: float) -> Column:
    """A bar that can be seen for any count over 0."""
    return F.when((n > 0) & (largest > 0), F.least(F.lit(plot), F.greatest(F.lit(2.0), n / largest * plot))).otherwise(F.lit(0.0))


def bubble_radius(n: Column, largest: Column, least: float = 6.0, most: float = 34.0) -> Column:
    return F.when((n > 0) & (largest > 0), F.greatest(F.lit(least), F.least(F.lit(most), most * F.sqrt(n / largest)))).otherwise(F.lit(0.0))


def ease(t: Column) -> Column:
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3)) / 2)


def between(start: Column, end: Column, progress: Column) -> Column:
    return start + (end - start) * ease(progress)


def animation_ms(years: Column) -> Column:
    """All steps between years with their pauses: about 21 seconds, a step of 1.4 to 1.8."""
    steps = F.greatest(F.lit(1), years - 1)
    step = F.greatest(F.lit(1400.0), F.least(F.lit(1800.0), 21_000 / steps - 400))
    return F.floor(steps * (step + 400) + 0.5).cast("long")


def medal_seconds(family: Column, era: Column, sex: Column) -> Column:
    return F.when(family == "long", F.coalesce(*(F.when((era == e) & (sex == s), t) for (e, s), t in MEDALS.items())))


def gap_text(gap: Column) -> Column:
    """m:ss or h:mm:ss before or behind a reference; a gap is the reference's time less the runner's."""
    t = F.floor(F.abs(gap) + 0.5)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    short = F.concat(F.floor(t / 60).cast("string"), F.lit(":"), two(t % 60))
    long = F.concat(F.floor(t / 3600).cast("string"), F.lit(":"), two(F.floor(t % 3600 / 60)), F.lit(":"), two(t % 60))
    side = F.when(gap > 0, " före").otherwise(" efter")
    return F.when(gap.isNull() | (F.abs(gap) <= 1), "i nivå").otherwise(F.concat(F.when(t < 3600, short).otherwise(long), side))


def window_state(day: Column, first: str, last: str) -> Column:
    return F.when(day < F.to_date(F.lit(first)), "before").when(day <= F.to_date(F.lit(last)), "active").otherwise("after")


def nice_step(raw: Column) -> Column:
    """The next of 1, 2, 5 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    f = raw / power
    return F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0) * power


def haversine(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Kilometres over the earth's mean radius."""
    a, b = F.radians(lat0), F.radians(lat1)
    s = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon1) - F.radians(lon0)) / 2), F.lit(2))
    return F.when(s.isNotNull(), 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(s))))  # least alone would skip a null
