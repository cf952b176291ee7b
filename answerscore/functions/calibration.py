"""Numeric functions of the scorer as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscore.config import Config


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN and null become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def soft_credit(similarity: Column, soft_min: float = 0.72, soft_w: float = 1.0) -> Column:
    t = (similarity - soft_min) / (1 - soft_min)
    return F.when(similarity < soft_min, 0.0).otherwise(soft_w * t * t)


def f_beta(p: Column, r: Column, beta2: float = 0.36) -> Column:
    return F.when(beta2 * p + r > 0, (1 + beta2) * p * r / (beta2 * p + r)).otherwise(0.0)


def smooth(x: Column) -> Column:
    return x * x * (3.0 - 2.0 * x)


def smoothsteps(x: Column, times: int, pivot: float = 0.5, fraction: float = 0.0) -> Column:
    """Repeated smoothsteps around ``pivot``, the last one by ``fraction``."""
    if times > 0:
        if 0 < pivot < 1 and abs(pivot - 0.5) > 1e-6:
            x = F.when(x <= pivot, 0.5 * x / pivot).otherwise(0.5 + 0.5 * (x - pivot) / (1 - pivot))
        for _ in range(times):
            x = smooth(x)
        if fraction > 0:
            x = x + fraction * (smooth(x) - x)
    return x


def step(x: Column, threshold, width: float = 0.0) -> Column:
    """0 below and 1 from the threshold on, or a ramp of half-width ``width`` around it."""
    if width > 0:
        return clamp01((x - (threshold - width)) / (2.0 * width))
    return F.when(x >= threshold, 1.0).otherwise(0.0)


def step_tiebreak(x: Column, tie: Column, threshold, b, width: float = 0.0) -> Column:
    return clamp01((1.0 - b) * step(x, threshold, width) + b * clamp01(tie))


def logistic(x: Column, k: float, c: float) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (x - c)))


def rel_close(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Figures within 0.5 % of the larger one."""
    m = F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) / F.when(m > 1e-6, m).otherwise(1.0) <= tolerance


def fixture_count(margin: Column, floor: float = 0.010046, span: float = 0.98, cases: int = 32) -> Column:
    """How many of ``cases`` a margin stands for."""
    return (margin - floor) / span * cases


def proxy_estimate(rho: Column, offset: float = 0.062) -> Column:
    """What a rank agreement with the proxy stands for on the real corpus: less by a fixed offset."""
    return rho - offset


def calibrated(raw: Column, config: Config, ties: dict[int, Column] | None = None, r: Column | None = None) -> Column:
    """The last step of a score: threshold with tie-break, logistic curve, or contrast, as the config says."""
    raw = clamp01(raw)
    if config.step_t > 0:
        h = step(raw, config.step_t, config.step_w)
        if config.step_r > 0 and r is not None:
            h = F.when(r < config.step_r, 0.0).otherwise(h)
        ties = {0: raw} | (ties or {})
        if config.tie_src not in ties:
            raise ValueError(f"tie source {config.tie_src} is unknown or needs similarities")
        tie = ties[config.tie_src]
        return clamp01((1.0 - config.step_b) * h + config.step_b * clamp01(tie))
    if config.sigk > 0:
        return clamp01(logistic(raw, config.sigk, config.sigc))
    out = clamp01(config.sharpen * smooth(raw) + (1 - config.sharpen) * raw) if config.sharpen > 0 else raw
    return clamp01(smoothsteps(out, config.post_iters, config.post_pivot, config.post_frac))
