"""Special functions and rank expressions as Spark columns.

Spark SQL has no erf, log-gamma or incomplete beta; each is a folded series here,
so that it stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _fold(n: int, start: Column, step, finish) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, finish)


def erf(x: Column, terms: int = 120) -> Column:
    """Error function by a series of positive terms; plus or minus 1 beyond 5."""
    z = F.least(F.abs(x), F.lit(5.0))
    start = F.struct(z.alias("t"), z.alias("s"))
    step = lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s"))
    series = _fold(terms, start, step, lambda a: a["s"])
    value = series * (2 / math.sqrt(math.pi)) * F.exp(-z * z)
    return F.when(F.abs(x) >= 5, F.signum(x)).otherwise(F.signum(x) * value)


def normal_upper_tail(z: Column) -> Column:
    """Probability that a standard normal variable is above z; from 2 on by a continued fraction, so that small values keep their digits."""
    x = F.greatest(F.abs(z) / math.sqrt(2), F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda f, k: x + k / 2 / f)
    beyond = F.exp(-x * x) / (2 * math.sqrt(math.pi)) / fraction
    return F.when(z >= 2, beyond).when(z <= -2, 1 - beyond).otherwise(F.lit(0.5) - erf(z / math.sqrt(2)) * 0.5)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: the asymptotic series at x + 8, brought back by recurrence."""
    up = x + 8
    inv = 1 / (up * up)
    series = (1 / 12.0 - inv * (1 / 360.0 - inv * (1 / 1260.0 - inv * (1 / 1680.0 - inv * (1 / 1188.0))))) / up
    back = sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - back


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularized incomplete beta function by its continued fraction, on the side of the mean where that converges.

    Steps end when a step changes nothing; that takes about the square root of the
    smaller parameter, and as many are allowed three times over. Null if it still moves then.
    """
    swap = x > (a + 1) / (a + b + 2)
    xx, aa, bb = F.when(swap, 1 - x).otherwise(x), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    front = F.exp(log_gamma(aa + bb) - log_gamma(aa) - log_gamma(bb) + aa * F.ln(xx) + bb * F.ln(1 - xx)) / aa
    state = lambda c, d, h, done: F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done"))
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    one = F.lit(1.0)

    def step(s: Column, m: Column) -> Column:
        even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        half = F.transform(F.array(s), lambda s: F.struct(safe(1 + even / s["c"]).alias("c"), (1 / safe(1 + even * s["d"])).alias("d"), s["h"].alias("h")))
        half = F.transform(half, lambda s: F.struct(s["c"], s["d"], (s["h"] * s["c"] * s["d"]).alias("h")))
        whole = F.transform(half, lambda s: F.struct(safe(1 + odd / s["c"]).alias("c"), (1 / safe(1 + odd * s["d"])).alias("d"), s["h"].alias("h")))
        moved = F.transform(whole, lambda s: state(s["c"], s["d"], s["h"] * s["c"] * s["d"], F.abs(s["c"] * s["d"] - 1) < 1e-15))[0]
        return F.when(s["done"], s).otherwise(moved)

    first = 1 / safe(1 - (aa + bb) * xx / (aa + 1))
    most = F.least(F.lit(1e6), 100 + 3 * F.sqrt(F.least(aa, bb))).cast("int")
    fraction = F.aggregate(F.sequence(F.lit(1), most), state(one, first, first, F.lit(False)), step, lambda s: F.when(s["done"], s["h"]))
    value = F.when(xx <= 0, 0.0).otherwise(front * fraction)
    return F.when(swap, 1 - value).otherwise(value)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def f_upper_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Probability that an F variable with d1 and d2 degrees of freedom is above f."""
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def _hypergeometric(a: Column, b: Column, c: Column, d: Column):
    """Of the table ((a, b), (c, d)): least and greatest possible first entry, its mode, the probability of an entry, and sums away from an entry.

    ``beyond(k, p, n, up, least)``: the probabilities of the entries k, k + 1, ... (or k - 1, ... if not ``up``)
    no larger than ``least``, starting from that of k, p, n of them at most, each from the one before. The sums go
    over as many entries as matter, in proportion to the standard deviation whatever the size of the table.
    """
    row, col, n = ((x + y).cast("double") for x, y in ((a, b), (a, c), (a + b, c + d)))
    low, high = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)
    mode = F.least(high, F.greatest(low, F.floor((row + 1) * (col + 1) / (n + 2))))
    at = lambda k: F.exp(log_choose(col, k) + log_choose(n - col, row - k) - log_choose(n, row))
    spread = F.sqrt(row / n * col * (1 - row / n) * (1 - col / n) * n / F.greatest(n - 1, F.lit(1.0)))
    matter = F.ceil(12 * F.coalesce(spread, F.lit(0.0)) + 60)

    def beyond(k: Column, p: Column, up: bool, least: Column | None = None) -> Column:
        entries = F.least(matter, high - k if up else k - low).cast("int")
        steps = F.when(entries > 0, F.sequence(F.lit(1), entries)).otherwise(F.array().cast("array<int>"))
        state = lambda p, sum_, most: F.struct(p.alias("p"), sum_.alias("sum"), most.alias("most"))

        def step(s: Column, j: Column) -> Column:
            at_ = k + j - 1 if up else k - j + 1
            ratio = (col - at_) * (row - at_) / ((at_ + 1) * (n - col - row + at_ + 1)) if up else at_ * (n - col - row + at_) / ((col - at_ + 1) * (row - at_ + 1))
            p_ = s["p"] * ratio
            return state(p_, s["sum"] + F.when(p_ <= s["most"], p_).otherwise(0.0), s["most"])

        # What does not change from step to step is worked out once, before the first.
        first = F.transform(F.array(F.struct(p.alias("p"), (F.lit(2.0) if least is None else least).alias("most"))), lambda f: state(f["p"], F.when(f["p"] <= f["most"], f["p"]).otherwise(0.0), f["most"]))[0]
        return F.aggregate(steps, first, step, lambda s: s["sum"])

    return low, high, mode, at, beyond


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact test of the table ((a, b), (c, d)): all tables no likelier than it. Tables with a zero margin give 1."""
    _, _, mode, at, beyond = _hypergeometric(a, b, c, d)
    k = a.cast("double")
    seen = at(k) * (1 + 1e-7)
    # Away from the mode all tables are less likely; on its other side some are.
    up = beyond(k, at(k), True) + beyond(mode, at(mode), False, seen)
    down = beyond(k, at(k), False) + beyond(mode, at(mode), True, seen)
    total = F.when(k > mode, up).when(k < mode, down).otherwise(1.0)
    return F.least(F.lit(1.0), total)


def hypergeometric_tail(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Probability of ``a`` or more marked members, from the table ((a, b), (c, d))."""
    low, _, mode, at, beyond = _hypergeometric(a, b, c, d)
    k = a.cast("double")
    return F.least(F.lit(1.0), F.when(k <= low, 1.0).when(k > mode, beyond(k, at(k), True)).otherwise(1 - beyond(k - 1, at(k - 1), False)))


def over_all(*partition: str) -> WindowSpec:
    return Window.partitionBy(*partition)


def average_rank(value: str | Column, *partition: str) -> Column:
    """Rank from 1 with ties averaged."""
    value = F.col(value) if isinstance(value, str) else value
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (ties - 1) / 2.0


def ordinal_rank(value: str, position: str, *partition: str) -> Column:
    """Rank from 1, ties in order of position."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(value, position))


def contrast(a: Column, b: Column) -> Column:
    return (a - b) / (a + b)


def binary_reduction(x: Column, eta: Column, varpi: Column) -> Column:
    """Smooth switch at ``eta`` of width ``varpi``, weighted by the ratio of geometric and arithmetic mean of x and eta."""
    return 0.5 * (1 + F.tanh((x - eta) / varpi)) * F.sqrt(x * eta) / (0.5 * (eta + x))


def soft_threshold(x: Column, eta: Column, varpi: Column) -> Column:
    """Low values suppressed smoothly."""
    return x * binary_reduction(x, eta, varpi)


def soft_maximum(x: Column, least: Column, eta: Column, varpi: Column) -> Column:
    """As ``soft_threshold``, with the switch measured from the least value."""
    return x * binary_reduction(x - least, eta - least, varpi)


def harmonic_overlap(a: Column, b: Column) -> Column:
    return 2 * a * b / (a + b)


def scale_free_overlap(a: Column, b: Column) -> Column:
    return 4 * a * b / ((a + b) * (a + b))


def sign_up(x: Column) -> Column:
    """Sign with that of zero taken as +1."""
    return F.when(x >= 0, 1).otherwise(-1)


def is_prime(n: Column) -> Column:
    """Whether a whole number is prime, by trial division."""
    root = F.floor(F.sqrt(n)).cast("long")
    return F.when(n < 2, False).when(n < 4, True).otherwise(F.forall(F.sequence(F.lit(2).cast("long"), root), lambda k: n % k != 0))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number, 1 and 1 being the first; null below 1 and beyond 92, the last that a long holds."""
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    step = lambda s, _: F.struct(s["b"].alias("a"), F.try_add(s["a"], s["b"]).alias("b"))
    return F.when((n >= 1) & (n <= 92), F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(92))).cast("int")), zero, step, lambda s: s["a"]))


def overlap_excess(a: Column, b: Column, n: int) -> Column:
    """The harmonic overlap less n / (n + 1)."""
    return harmonic_overlap(a, b) - n / (n + 1)


def flatness(x: Column) -> Column:
    """Aggregate: geometric over arithmetic mean of positive values; 1 less it is their contrast."""
    return F.exp(F.avg(F.ln(x))) / F.avg(x)


def radial_polynomial(r: Column, n: int, m: int, whole: bool = True) -> Column:
    """Zernike's radial polynomial of degree n and order m (n - m even) for r from 0 to 1, else 0. Without ``whole`` the term of lowest power is left out."""
    if m > n or (n - m) % 2:
        return F.lit(0.0)
    f, last = math.factorial, (n - m) // 2
    terms = [(-1) ** k * f(n - k) / (f(k) * f((n + m) // 2 - k) * f(last - k)) * F.pow(r, n - 2 * k) for k in range(last + whole)]
    return F.when((r >= 0) & (r <= 1), sum(terms, F.lit(0.0))).otherwise(0.0)


def _turned(s: Column, side: Column, rx: Column, ry: Column) -> tuple[Column, Column]:
    """A quadrant's x and y as the curve enters it: flipped and swapped, swapped, or as they are."""
    flip = lambda v: F.when(rx == 1, side - 1 - v).otherwise(v)
    return F.when(ry == 0, flip(s["y"])).otherwise(s["x"]), F.when(ry == 0, flip(s["x"])).otherwise(s["y"])


def _sides(n: int) -> list[int]:
    if n < 1 or n & (n - 1):
        raise ValueError("the grid's side must be a power of two")
    return [1 << k for k in range(n.bit_length() - 1)]


def hilbert_place(n: int, x: Column, y: Column) -> Column:
    """Place from 0 of the cell (x, y) along Hilbert's curve over n times n cells."""
    long = lambda c: c.cast("long")
    start = F.struct(long(x).alias("x"), long(y).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, side: Column) -> Column:
        rx, ry = (F.when(s[c].bitwiseAND(side) > 0, 1).otherwise(0) for c in "xy")
        nx, ny = _turned(s, F.lit(n).cast("long"), rx, ry)
        return F.struct(nx.alias("x"), ny.alias("y"), (s["d"] + side * side * (3 * rx).bitwiseXOR(ry)).alias("d"))

    if n == 1:
        return F.lit(0).cast("long")
    return F.aggregate(F.array(*[F.lit(s).cast("long") for s in reversed(_sides(n))]), start, step, lambda s: s["d"])


def hilbert_point(n: int, place: Column) -> Column:
    """The cell, a struct of x and y, at a place along Hilbert's curve over n times n cells."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), place.cast("long").alias("t"))

    def step(s: Column, side: Column) -> Column:
        rx = F.shiftright(s["t"], 1).bitwiseAND(1)
        ry = s["t"].bitwiseXOR(rx).bitwiseAND(1)
        nx, ny = _turned(s, side, rx, ry)
        return F.struct((nx + side * rx).alias("x"), (ny + side * ry).alias("y"), F.shiftright(s["t"], 2).alias("t"))

    sides = F.array(*[F.lit(s).cast("long") for s in _sides(n)]) if n > 1 else F.array().cast("array<long>")
    return F.aggregate(sides, start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


#: Neighbours of a cell as steps in x and y: around it from above clockwise, and the four beside it.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
BESIDE = ((-1, 0), (1, 0), (0, -1), (0, 1))


def hilbert_neighbours(n: int, place: Column, steps: tuple[tuple[int, int], ...] = AROUND, periodic: bool = True) -> Column:
    """Places of a cell and of its neighbours, going round the borders or, if not ``periodic``, stopping at them."""
    at = hilbert_point(n, place)
    held = (lambda v: F.pmod(v, F.lit(n))) if periodic else (lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)))
    moved = F.transform(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]), lambda s: hilbert_place(n, held(at["x"] + s["a"]), held(at["y"] + s["b"])))
    return F.concat(F.array(place.cast("long")), moved)


def condensed_index(n: Column, i: Column, j: Column) -> Column:
    """Place of the pair i < j in the upper triangle of n items, row by row."""
    return i * n - (i * (i + 1) / 2).cast("long") + j - i - 1


def vector_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def beta_to_m(b: Column) -> Column:
    return F.log2(b / (1 - b))


def m_to_beta(m: Column) -> Column:
    return F.pow(2.0, m) / (1 + F.pow(2.0, m))
