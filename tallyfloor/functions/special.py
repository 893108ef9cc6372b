"""Special functions that Spark lacks, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def digamma(x: Column) -> Column:
    """Digamma for x > 0: shift to x + 8 by recurrence, then the asymptotic series."""
    z = x + 8.0
    shift = sum((1.0 / (x + float(i)) for i in range(1, 8)), 1.0 / x)
    i2 = 1.0 / (z * z)
    # B_2k / 2k of the asymptotic series.
    series = i2 * (
        1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 * (1 / 132 - i2 * (691 / 32760)))))
    )
    return F.log(z) - 0.5 / z - series - shift


def normal_tail(z: str) -> Column:
    """P(N > z) for column name ``z``: a power series near zero, a continued fraction beyond."""
    return F.expr(_normal_tail(f"`{z}`"))


def _normal_tail(z: str) -> str:
    a = f"abs({z})"
    term = (
        f"aggregate(sequence(1, 60), named_struct('s', {a}, 't', {a}), "
        f"(acc, k) -> named_struct('s', acc.s + acc.t * {a} * {a} / (2 * k + 1), "
        f"'t', acc.t * {a} * {a} / (2 * k + 1)), acc -> acc.s)"
    )
    density = f"exp(-0.5D * {a} * {a}) / {math.sqrt(2 * math.pi)!r}D"
    near = f"(0.5D - {density} * {term})"
    far = f"({density} / aggregate(sequence(60, 1), {a}, (acc, k) -> {a} + k / acc))"
    upper = f"(CASE WHEN {a} < 3D THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1D - {upper} END)"


def t_tail_two_sided(t: str, df: str) -> Column:
    """P(|T| > |t|) with ``df`` degrees of freedom: the finite cosine sum for whole ``df`` up to 400, beyond it a normal tail at a point
    shifted by an asymptotic series (Hill's Algorithm 395), whose error is below 1e-12 there. The cost does not grow with ``df``."""
    a = f"(cast(`{df}` as double) - 0.5D)"
    b = f"(48D * {a} * {a})"
    z = f"sqrt({a} * log1p(`{t}` * `{t}` / cast(`{df}` as double)))"
    shifted = (
        f"x + ((x * x + 3D) * x / {b}) - (((4D * x * x + 33D) * x * x + 240D) * x * x + 855D) * x / (10D * {b} * ({b} + 0.8D * pow(x, 4) + 100D))"
    )
    many = f"2D * transform(transform(array({z}), x -> {shifted}), y -> {_normal_tail('y')})[0]"
    df_small = f"least(`{df}`, 400)"
    theta = f"atan(abs(`{t}`) / sqrt(cast(`{df}` as double)))"
    even = (
        f"sin({theta}) * aggregate(IF({df_small} >= 4, sequence(1, cast({df_small} div 2 as int) - 1), array()), "
        f"named_struct('s', 1D, 'c', 1D), (acc, k) -> named_struct("
        f"'s', acc.s + acc.c * (2 * k - 1) / (2D * k) * pow(cos({theta}), 2), "
        f"'c', acc.c * (2 * k - 1) / (2D * k) * pow(cos({theta}), 2)), acc -> acc.s)"
    )
    odd = (
        f"2D / pi() * ({theta} + IF({df_small} >= 3, sin({theta}) * cos({theta}) * aggregate("
        f"IF({df_small} >= 5, sequence(1, cast(({df_small} - 3) div 2 as int)), array()), "
        f"named_struct('s', 1D, 'c', 1D), (acc, k) -> named_struct("
        f"'s', acc.s + acc.c * (2D * k) / (2 * k + 1) * pow(cos({theta}), 2), "
        f"'c', acc.c * (2D * k) / (2 * k + 1) * pow(cos({theta}), 2)), acc -> acc.s), 0D))"
    )
    few = f"greatest(0D, 1D - IF(`{df}` % 2 = 0, {even}, {odd}))"
    return F.expr(f"CASE WHEN `{df}` > 400 THEN {many} ELSE {few} END")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, shifted down."""
    x = n + 9.0
    down = sum((F.log(n + float(i)) for i in range(2, 9)), F.log(n + 1.0))
    i2 = 1.0 / (x * x)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680)))) / x
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - down


def binomial_limit(k: str, n: str, alpha: float, side: str) -> Column:
    """Exact (tail-inversion) limit of a binomial share; ``side`` is "low" or "high"."""
    # P(X >= k) as a sum of terms by ratio from the first one, evaluated in logs.
    lo, hi = ("`%s`" % k, "`%s`" % n) if side == "low" else ("0", "`%s`" % k)
    p = "(acc.lo + acc.step)"

    def logc(i):
        return (
            f"aggregate(IF({i} >= 1, sequence(1, cast({i} as int)), array()), 0D, "
            f"(c, j) -> c + ln((`{n}` - j + 1) / cast(j as double)))"
        )

    tail = (
        f"aggregate(sequence(cast({lo} as int), cast({hi} as int)), 0D, (s, i) -> s + exp("
        f"{logc('i')} + i * ln({p}) + (`{n}` - i) * ln(1D - {p})))"
    )
    test = f"{tail} < {alpha / 2!r}D" if side == "low" else f"{tail} > {alpha / 2!r}D"
    search = (
        f"aggregate(sequence(1, 45), named_struct('lo', 0D, 'step', 0.5D), "
        f"(acc, it) -> named_struct('lo', IF({test}, {p}, acc.lo), 'step', acc.step / 2D), acc -> acc.lo)"
    )
    edge = f"`{k}` = 0 THEN 0D" if side == "low" else f"`{k}` = `{n}` THEN 1D"
    return F.expr(f"CASE WHEN {edge} ELSE {search} END")
