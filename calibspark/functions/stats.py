"""Statistical column expressions: exact paired test, odds ratio, pass@k.

All are built-in higher-order expressions, so they stay inside whole-stage
code generation and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln(x!) - ((x + 1/2) ln x - x + ln(2 pi) / 2) for x = 1 .. 24, from the factorials themselves
_REST = [math.log(math.factorial(x)) - ((x + 0.5) * math.log(x) - x + 0.5 * math.log(2 * math.pi)) for x in range(1, 25)]


def _factorial_rest(x: Column) -> Column:
    """What ln(x!) has beyond its leading term, x >= 1: a table up to 24, then four terms of its series in 1/x."""
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    table = F.element_at(F.array(*[F.lit(v) for v in _REST]), F.least(x, F.lit(len(_REST))).cast("int"))
    return F.when(x <= len(_REST), table).otherwise(series)


def binom_half_point(m: Column, n: Column) -> Column:
    """P(Bin(n, 1/2) = m).  With d = (n - 2 m) / n the leading terms are
    n / 2 ((1 - d) ln(1 - d) + (1 + d) ln(1 + d)), which doesn't cancel."""
    md, nd = m.cast("double"), n.cast("double")
    d = (nd - 2 * md) / nd
    lead = nd / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    rest = _factorial_rest(nd) - _factorial_rest(md) - _factorial_rest(nd - md)
    inner = F.exp(rest - lead - F.log(F.lit(2 * math.pi) * md * (nd - md) / nd) / 2)
    return F.when((m == 0) | (m == n), F.pow(F.lit(0.5), nd)).otherwise(inner)


def binom_half_cdf(m: Column, n: Column) -> Column:
    """P(Bin(n, 1/2) <= m) for m <= n / 2: the last term times the sum of the
    terms' ratios to it.  Ratios beyond 10 sqrt(n) + 100 steps are below
    exp(-200) of the sum, far under what a double holds, for every n."""
    nd, md = n.cast("double"), m.cast("double")
    steps = F.least(m.cast("double"), F.lit(10.0) * F.sqrt(nd) + 100).cast("int")
    count = F.slice(F.sequence(F.lit(0), steps), 1, steps)  # 0 .. steps - 1, empty for 0
    ratios = F.aggregate(count, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s")),
                         lambda a, i: F.struct((a["r"] * (md - i) / (nd - md + i + 1)).alias("r"),
                                               (a["s"] + a["r"] * (md - i) / (nd - md + i + 1)).alias("s")))["s"]
    return binom_half_point(m, n) * ratios


def mcnemar_exact_p(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p-value: min(1, 2 P(Bin(b+c, 1/2) <= min(b, c)));
    1 when there are no discordant pairs.  One formula for all counts; the work
    per row is O(sqrt(b + c))."""
    n = b + c
    return (F.when(n == 0, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), F.lit(2.0) * binom_half_cdf(F.least(b, c), n))))


def paired_odds_ratio(b: Column, c: Column) -> Column:
    """b / c; null when c = 0 (see ``or_infinite``)."""
    return F.when(c == 0, F.lit(None).cast("double")).otherwise(b.cast("double") / c)


def or_infinite(b: Column, c: Column) -> Column:
    """True where the odds ratio is +infinity (b > 0, c = 0)."""
    return (c == 0) & (b > 0)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k for one problem: 1 - C(n-c, k) / C(n, k), as the
    product of k ratios (n-c-j) / (n-j) -- work bounded by k, not by n or c."""
    prod = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0),
                       lambda acc, j: acc * (n - c - j).cast("double") / (n - j))
    return (F.when(n - c < k, F.lit(1.0))
            .when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - prod))
