"""Sentiment values and the colours that stand for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From very negative to very positive; polarization from low to high; and for low
#: and high polarization, from negative over neutral to positive.
NET = ("#ff0000", "#ff7f7f", "#f0f0f0", "#009dff", "#0000ff")
POLAR = ("#000000", "#ca79fc", "#8000ff")
STORY_LOW = ("#ff8000", "#808080", "#00cc22")
STORY_HIGH = ("#ff0000", "#8000ff", "#0000ff")


def net_value(positive: Column, neutral: Column, negative: Column) -> Column:
    """Positive less negative share, each pulled to zero by half of the neutral share."""
    damp = neutral * 0.5
    return (positive - F.least(positive, damp)) - (negative - F.least(negative, damp))


def net_color(value: Column) -> Column:
    """One of five colours for -1 to 1; halves round to even."""
    return F.element_at(F.array(*map(F.lit, NET)), (F.bround((value + 1) * 2) + 1).cast("int"))


def polarization(positive: Column, negative: Column) -> Column:
    return F.least(positive, negative) * 2


def polar_color(value: Column) -> Column:
    return F.when(value < 0.40, POLAR[0]).when(value < 0.80, POLAR[1]).otherwise(POLAR[2])


def story_color(net: Column, polar: Column) -> Column:
    """By polarization and the plain net share: three sides where polarization is low, two where it
    is middling, and one colour where it is high."""
    low = F.when(net < -0.25, STORY_LOW[0]).when(net <= 0.25, STORY_LOW[1]).otherwise(STORY_LOW[2])
    middle = F.when(net > 0, STORY_HIGH[2]).otherwise(STORY_HIGH[0])
    return F.when(polar < 0.40, low).when(polar < 0.80, middle).otherwise(STORY_HIGH[1])


def net_score(positive: Column, negative: Column) -> Column:
    """(p + n) * (p - n)."""
    return (positive + negative) * (positive - negative)


def polar_score(positive: Column, negative: Column) -> Column:
    """(p + n) * min / max, where a max of 0 counts as 1."""
    most = F.greatest(positive, negative)
    return (positive + negative) * F.least(positive, negative) / F.when(most <= 0, 1.0).otherwise(most)
