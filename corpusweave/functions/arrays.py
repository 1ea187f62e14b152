"""Array functions: windows, n-grams, repeats, diversity and token statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), computing value once for each row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def windows(items: Column, size: int, stride: int = 1, least: int | None = None) -> Column:
    """Windows of `size` items, every `stride`; a shorter array of at least `least` items is one
    window, and a trailing partial window is dropped."""

    def of(a: Column) -> Column:
        n = F.size(a)
        full = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride)), lambda i: F.slice(a, i + 1, size))
        empty = F.slice(F.array(a), 1, 0)
        short = F.when(n >= least, F.array(a)).otherwise(empty) if least is not None else empty
        return F.when(n >= size, full).otherwise(short)

    return let(items, of)


def ngrams(items: Column, n: int, joiner: str = "\u0001") -> Column:
    """The contiguous n-grams as strings; none if there are fewer than n items."""
    return F.transform(windows(items, n), lambda w: F.array_join(w, joiner))


def diversity(items: Column) -> Column:
    """Distinct share; 0 if empty."""
    return let(items, lambda a: F.when(F.size(a) > 0, F.size(F.array_distinct(a)) / F.size(a)).otherwise(0.0))


def repeat_share(items: Column) -> Column:
    """1 - distinct share; 0 if empty."""
    return let(items, lambda a: F.when(F.size(a) > 0, 1.0 - F.size(F.array_distinct(a)) / F.size(a)).otherwise(0.0))


def counts(items: Column) -> Column:
    """How often each distinct item occurs, from one sort."""

    def of(s: Column) -> Column:
        start = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(start, lambda b: F.transform(b, lambda x, i: F.coalesce(F.get(b, i + 1), F.size(s)) - x))

    return F.when(F.size(items) > 0, let(F.array_sort(items), of)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column, body: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, c: acc + body(c))


def _gini(c: Column, n: Column) -> Column:
    weighted = let(F.array_sort(c), lambda s: F.aggregate(F.transform(s, lambda x, i: (x * (i + 1)).cast("double")), F.lit(0.0), lambda a, x: a + x))
    return 2 * weighted / (F.size(c) * n) - (F.size(c) + 1) / F.size(c)


def _squares(c: Column) -> Column:
    return _sum(c, lambda x: (x * x).cast("double"))


def _top(k: int) -> Callable[[Column, Column], Column]:
    return lambda c, n: _sum(F.slice(F.sort_array(c, asc=False), 1, k), lambda x: x.cast("double")) / n


#: Measures of the counts c of n items.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "yule_k": lambda c, n: F.lit(10000.0) * (_squares(c) - n) / (n * n),
    "gini": _gini,
    "simpson": lambda c, n: _squares(c) / (n * n),
    "hill_d2_norm": lambda c, n: n * n / _squares(c) / F.size(c),
    "entropy": lambda c, n: -_sum(c, lambda x: x / n * F.ln(x / n)),
    "top_10": _top(10),
    "repeat_rate": lambda c, n: _sum(c, lambda x: F.when(x > 1, x).otherwise(0).cast("double")) / n,
    "repeat_mass": lambda c, n: _sum(c, lambda x: (x - 1).cast("double")) / n,
    "hapax_rate": lambda c, n: _sum(c, lambda x: F.when(x == 1, 1.0).otherwise(0.0)) / n,
    "max_rate": lambda c, n: F.array_max(c) / n,
}


def measures(items: Column, *names: str) -> Column:
    """struct of the named measures (all, if none is named), from one count of the items; null if
    there are none."""

    def of(a: Column) -> Column:
        n = F.size(a).cast("double")
        return F.when(n > 0, let(counts(a), lambda c: F.struct(*[MEASURES[k](c, n).alias(k) for k in names or MEASURES])))

    return let(items, of)


def _one(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(items, lambda a: F.when(F.size(a) > 0, let(counts(a), lambda c: body(c, F.size(a).cast("double")))).otherwise(F.lit(0.0)))


def repeated_occurrence_rate(items: Column) -> Column:
    """Share of the items that occur more than once; 0 if empty."""
    return _one(items, MEASURES["repeat_rate"])


def repetition_mass(items: Column) -> Column:
    return _one(items, MEASURES["repeat_mass"])


def shannon_entropy(items: Column) -> Column:
    return _one(items, MEASURES["entropy"])


def coverage(items: Column, top: int) -> Column:
    """Share of the `top` most frequent items; 0 if empty."""
    return _one(items, _top(top))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def distinct_jaccard(a: Column, b: Column) -> Column:
    """set_jaccard() of arrays without repeated items, whose union need not be made."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, let(F.size(F.array_intersect(a, b)), lambda k: k / (total - k))).otherwise(1.0)


def contains_run(values: Column, needle: list) -> Column:
    """Whether the literal run lies in the array."""
    if not needle:
        return F.lit(True)
    return F.exists(windows(values, len(needle)), lambda w: w == F.array(*[F.lit(x) for x in needle]))
