"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_choose(n: Column, k: Column) -> Column:
    """ln C(n, k); zero for k = 0, null for k > n or k < 0."""
    terms = F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))
    total = F.aggregate(terms, F.lit(0.0), lambda a, j: a + F.ln((n - j + 1).cast("double") / j))
    return F.when((k > n) | (k < 0), None).when(k == 0, 0.0).otherwise(total)


def hypergeom_tail(o: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= o) for X marked items among ``drawn`` of ``population``; drawn is small."""
    top = F.least(drawn, marked)
    whole = ln_choose(population, drawn)
    each = F.transform(F.sequence(o.cast("int"), top.cast("int")), lambda i: F.coalesce(F.exp(ln_choose(marked, i) + ln_choose(population - marked, drawn - i) - whole), F.lit(0.0)))
    return F.when(o <= 0, 1.0).when(o > top, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def z_score(value: Column, window) -> Column:
    """Within-group z; zero where the value is null or the group has no spread."""
    sd = F.stddev_samp(value).over(window)
    return F.coalesce(F.when(sd > 0, (value - F.avg(value).over(window)) / sd), F.lit(0.0))


def draw(seed: int, *key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key alone, not on partitions: 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), 1, 13), 16, 10).cast("double") / float(16**13)
