"""Column functions over probability arrays in a fixed class order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regimes in canonical order (fixed values).
REGIMES = ["Risk-On", "Late-Cycle", "Transitional", "Post-Shock", "Risk-Off"]


def fold(p: Column, fn) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + fn(x))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where lambdas inside body use it."""
    return F.transform(F.array(value), body).getItem(0)


def normalized(p: Column) -> Column:
    return let(p, lambda q: let(fold(q, lambda y: y), lambda s: F.transform(q, lambda x: x / s)))


def is_simplex(p: Column, tolerance: float = 1e-4) -> Column:
    return (F.size(p) == len(REGIMES)) & F.forall(p, lambda x: (x >= 0) & (x <= 1)) & (F.abs(fold(p, lambda x: x) - 1) <= tolerance)


def argmax(p: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column) -> Column:
    return -fold(p, lambda x: x * F.log(F.greatest(x, F.lit(1e-12))))


def label(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, REGIMES)), i + 1)


def at(p: Column, i: Column) -> Column:
    return F.element_at(p, i + 1)


def one_hot(i: Column, n: int = len(REGIMES)) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def log_loss(p: Column, y: Column) -> Column:
    return -F.log(F.greatest(at(p, y), F.lit(1e-12)))


def brier(p: Column, y: Column) -> Column:
    return fold(F.zip_with(p, one_hot(y), lambda a, b: (a - b) * (a - b)), lambda x: x)


def ranked_probability(p: Column, y: Column, order: list[int] | None = None) -> Column:
    """Mean squared difference of the cumulative distributions, over all but the last class."""
    order = order or list(range(len(REGIMES)))
    out, cum = F.lit(0.0), F.lit(0.0)
    for k in order[:-1]:
        cum = cum + F.get(p, F.lit(k)) - F.when(y == k, 1.0).otherwise(0.0)
        out = out + cum * cum
    return out / (len(order) - 1)


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Kullback-Leibler divergence after adding eps and normalizing both."""
    p, q = (normalized(F.transform(x, lambda v: v + eps)) for x in (p, q))
    return fold(F.zip_with(p, q, lambda a, b: a * F.log(a / b)), lambda x: x)


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * fold(F.zip_with(p, q, lambda a, b: F.abs(a - b)), lambda x: x)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (natural logarithm)."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.log(a / m)).otherwise(0.0) + F.when(b > 0, b * F.log(b / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), fold(F.zip_with(p, q, part), lambda x: x) / 2))


def prediction_set(p: Column, mass: Column) -> Column:
    """Class indices in descending probability until they hold `mass`; of equal ones the higher index first. Never empty."""

    def chosen(ranked: Column) -> Column:
        below = lambda k: F.aggregate(F.slice(ranked, F.lit(1), k), F.lit(0.0), lambda a, x: a + x["x"])
        return F.transform(F.filter(ranked, lambda r, k: (k == 0) | (below(k) < mass)), lambda r: r["i"])

    return let(F.reverse(F.sort_array(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))), chosen)


def aps_score(p: Column, y: Column) -> Column:
    """Mass of all classes at least as likely as the true one."""
    return fold(F.filter(p, lambda x: x >= at(p, y)), lambda x: x)


def tempered(p: Column, temperature: Column | float) -> Column:
    """Softmax of the logarithms divided by a temperature."""
    z = F.transform(p, lambda x: F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))) / temperature)
    return let(z, lambda v: let(F.array_max(v), lambda m: normalized(F.transform(v, lambda x: F.exp(x - m)))))
