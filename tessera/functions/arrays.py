"""Functions of score arrays: normalisation, margins, entropy, blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Margin bins (label, lower bound).
MARGIN_BINS = [("negative", None), ("0_to_0.5", 0.0), ("0.5_to_1", 0.5), ("1_to_2", 1.0), ("2_to_4", 2.0), ("4_plus", 4.0)]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    """The mean; null for an empty array."""
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def softmax(scores: Column, temperature: float) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp((x - top) / temperature))
    return F.transform(exps, lambda e: e / total(exps))


def normalized_entropy(distribution: Column) -> Column:
    """Entropy over its maximum; 0 for at most one value."""
    entropy = -F.aggregate(distribution, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.when(F.size(distribution) <= 1, 0.0).otherwise(entropy / F.log(F.size(distribution).cast("double")))


def margin(value: Column, kind: str = "raw", temperature: float = 1.0) -> Column:
    return value if kind == "raw" else F.tanh(value / temperature)


def margin_bin(value: Column) -> Column:
    out = F.lit(MARGIN_BINS[0][0])
    for label, low in MARGIN_BINS[1:]:
        out = F.when(value >= low, F.lit(label)).otherwise(out)
    return out


def minmax(xs: Column, constant: float = 0.5) -> Column:
    """Scaled to 0 to 1; ``constant`` everywhere if all values are equal."""
    low, high = F.array_min(xs), F.array_max(xs)
    return F.transform(xs, lambda x: F.when(high == low, F.lit(constant)).otherwise((x - low) / (high - low)))


def blend(first: Column, second: Column, first_weight: float, scale: float = 1.0) -> Column:
    """Weighted sum of two arrays, each scaled to 0 to 1."""
    return F.zip_with(minmax(first), minmax(second), lambda a, b: F.lit(scale) * (F.lit(first_weight) * a + F.lit(1.0 - first_weight) * b))


def _times(xs: Column, factor: float) -> Column:
    return F.transform(xs, lambda x: x * factor)


def weighted_minmax(sources: list[tuple[Column, float]], scale: float = 1.0) -> Column:
    """Scaled arrays averaged by weight; sources without a positive weight don't count."""
    used = [(xs, w) for xs, w in sources if w > 0]
    whole = sum(w for _, w in used)
    out = None
    for xs, w in used:
        part = _times(minmax(xs), w / whole * scale)
        out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return out


def best_index(xs: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def hardest(scores: Column, n: int) -> Column:
    """0-based places of the ``n`` largest values, larger first, earlier first among equals."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["i"])


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def row_quality(pos: Column, neg: Column) -> Column:
    """Margins between positive and negative scores; null where either is empty."""
    fields = {
        "best_pos": F.array_max(pos),
        "max_neg": F.array_max(neg),
        "best_margin": F.array_max(pos) - F.array_max(neg),
        "all_margin": F.array_min(pos) - F.array_max(neg),
        "mean_margin": mean(pos) - mean(neg),
    }
    return F.when((F.size(pos) > 0) & (F.size(neg) > 0), F.struct(*(c.alias(n) for n, c in fields.items())))


def _within(xs: Column, top: Column, margin: float) -> Column:
    return F.transform(xs, lambda x: top - x <= margin)


def anti_regression(negatives: list[Column], margin_to_keep: float, hard_margin: float, best: list[Column]) -> Column:
    """For each negative: 1 less the margin if any surface's margin to its best positive is at most the hard margin, else 0."""
    risky = None
    for neg, top in zip(negatives, best):
        part = _within(neg, top, hard_margin)
        risky = part if risky is None else F.zip_with(risky, part, lambda a, b: a | b)
    return F.transform(risky, lambda r: F.when(r, 1.0 - margin_to_keep).otherwise(0.0))
