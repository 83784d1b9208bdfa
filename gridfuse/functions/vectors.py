"""Column functions on array<double> features; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_distance(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mean(a) -> Column:
    return total(a) / F.size(a)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def let(value, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def col(a) -> Column:
    return F.col(a) if isinstance(a, str) else a


def unit(a, floor: float = 1e-8) -> Column:
    """a over its length; shorter than `floor` stays as it is."""
    return let(col(a), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n < floor, 1.0).otherwise(n))))


def unit_strict(a, floor: float = 1e-12) -> Column:
    """a over its length where the squared length is over `floor`, else as it is."""
    return let(col(a), lambda v: let(dot(v, v), lambda q: F.when(q > floor, F.transform(v, lambda x: x / F.sqrt(q))).otherwise(v)))


def deviation(a) -> Column:
    """Sample standard deviation; null for one value."""
    return let(col(a), lambda v: let(mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda q, x: q + (x - m) * (x - m)) / F.nullif(F.size(v) - 1, F.lit(0)))))


def heat(sq, sigma: float) -> Column:
    """exp(-squared distance / (2 sigma**2))"""
    return F.exp(-sq / (2.0 * sigma * sigma))


def quantise_unit(a) -> Column:
    """Components of a unit vector as integers of -127..127."""
    return F.transform(a, lambda x: F.round(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 127).cast("int"))


def dot_int8(a, b) -> Column:
    """Product of two vectors that `quantise_unit` made, on the scale of the unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x) / (127.0 * 127.0)


def cosine(a, b, floor: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def repaired(a, key, seed: int = 1, floor: float = 1e-9, spread: float = 0.01) -> Column:
    """A series whose deviation is under `floor` gives way to noise of deviation `spread`, made from a hash of `key`."""

    def noise(i) -> Column:
        u, v = (F.shiftrightunsigned(F.xxhash64(key, i, F.lit(2 * seed + j)), 11) / 2.0**53 for j in (0, 1))
        return F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * F.pi() * v) * spread

    return let(col(a), lambda v: F.when(F.coalesce(deviation(v), F.lit(0.0)) < floor, F.transform(v, lambda x, i: noise(i))).otherwise(v))


def seed_cost(ts, feat, gap, alpha: float, compactness: float, euclid: bool = False) -> Column:
    """Price of a voxel at distance `gap` of a growing region: alpha * (1 - cosine, or the distance) + (1 - alpha) * gap / compactness."""
    return alpha * (F.sqrt(sq_distance(ts, feat)) if euclid else 1 - cosine(ts, feat)) + (1 - alpha) * gap / compactness


def region_distance(ts, feat, gap2, s: float, compactness: float) -> Column:
    """Squared offset over s plus squared feature difference over `compactness`."""
    return gap2 / s + sq_distance(ts, feat) / compactness


def quantise_weight(d) -> Column:
    """A weight of 0..2 in 16 bits."""
    return F.floor(F.least(F.greatest(d, F.lit(0.0)), F.lit(2.0)) * 32767.5).cast("int")


def normalised_heat(sq, size, sigma: float) -> Column:
    """`heat` of a squared distance over twice the number of components."""
    return F.exp(-sq / (2.0 * size) / (2.0 * sigma * sigma))


def correlation(a, b) -> Column:
    """Pearson's correlation from sums; null where one side is constant."""
    n, sa, sb = F.size(a), total(a), total(b)
    spread = (n * dot(a, a) - sa * sa) * (n * dot(b, b) - sb * sb)
    return (n * dot(a, b) - sa * sb) / F.sqrt(F.when(spread > 0, spread))


def fisher_z(r) -> Column:
    return 0.5 * F.log((1 + r) / (1 - r))


def hamming(a, b) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ranks(a) -> Column:
    """Rank of each entry, from 1; equal entries share the mean of their ranks."""
    less = lambda v, x: F.size(F.filter(v, lambda y: y < x))
    same = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    return let(col(a), lambda v: F.transform(v, lambda x: less(v, x) + (same(v, x) + 1) / 2.0))


def spearman(a, b) -> Column:
    """Correlation of ranks; null where one side is constant."""
    return let(F.struct(ranks(a).alias("a"), ranks(b).alias("b")), lambda r: correlation(r.a, r.b))


def median(a) -> Column:
    """Middle entry, or the mean of the two middle ones; null of an empty array."""
    at = lambda v, i: F.get(v, i.cast("int"))
    return let(F.array_sort(col(a)), lambda v: (at(v, F.floor((F.size(v) - 1) / 2)) + at(v, F.floor(F.size(v) / 2))) / 2)


def huber_location(a, k: float = 1.5, rounds: int = 50) -> Column:
    """Huber's location: from the median on, the mean of entries held within k scaled absolute deviations, `rounds` times; the median where these are zero."""
    spread = lambda v, m: 1.4826 * median(F.transform(v, lambda x: F.abs(x - m)))
    held = lambda v, m, s: total(F.transform(v, lambda x: F.least(F.greatest(x, m - k * s), m + k * s))) / F.size(v)

    def located(v) -> Column:
        return let(median(v), lambda m: let(spread(v, m), lambda s: F.when(s > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), m, lambda acc, _: held(v, acc, s))).otherwise(m)))

    return let(col(a), located)
