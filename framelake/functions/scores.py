"""Probabilities, losses and clip centres as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMOOTHING = 0.1


def pred_at(prob: Column, threshold: float) -> Column:
    return F.when(prob >= threshold, 1).otherwise(0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    clamped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(clamped / (1 - clamped))


def fuse_prob(spatial: Column, temporal: Column, weight: Column | float) -> Column:
    """The weighted mix of two branches' probabilities."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return w * spatial + (1 - w) * temporal


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_loss(x: Column, label: Column, pos_weight: float = 1.0, smoothing: float = SMOOTHING) -> Column:
    """Binary cross-entropy of a logit with smoothed labels."""
    y = label * (1 - smoothing) + 0.5 * smoothing
    return pos_weight * y * _softplus(-x) + (1 - y) * _softplus(x)


def focal_loss(x: Column, label: Column, alpha: float = 0.75, gamma: float = 2.0, smoothing: float = SMOOTHING) -> Column:
    """Cross-entropy weighed down where the model is already right."""
    y = label * (1 - smoothing) + 0.5 * smoothing
    p = sigmoid(x)
    right = p * y + (1 - p) * (1 - y)
    return (alpha * y + (1 - alpha) * (1 - y)) * F.pow(1 - right, F.lit(gamma)) * bce_loss(x, label, 1.0, smoothing)


#: The positions of a clip of eight frames.
OF_EIGHT = [2, 3, 4, 5]


def center_candidates(clip_len: int) -> list[int]:
    """Positions from which a clip's spatial frame may be taken: the middle one and its neighbours, as far as they exist."""
    if clip_len == 8:
        return list(OF_EIGHT)
    middle = clip_len // 2
    return [k for k in (middle - 1, middle, middle + 1) if 0 <= k < clip_len]


def default_position(candidates: list[int]) -> int:
    """The middle candidate, the later of two; 0 without any."""
    return candidates[len(candidates) // 2] if candidates else 0


def default_center(candidates: Column) -> Column:
    return F.when(F.size(candidates) > 0, F.element_at(candidates, (F.size(candidates) / 2).cast("int") + 1)).otherwise(0)


def inside_clip(candidates: Column, clip_len: Column | int) -> Column:
    """Those inside the clip; null without any."""
    inside = F.filter(candidates, lambda k: (k >= 0) & (k < clip_len))
    return F.when(F.size(inside) > 0, inside)


def valid_candidates(candidates: Column, clip_len: Column | int, fallback: Column) -> Column:
    """Those inside the clip; without any, the fallback."""
    return F.coalesce(inside_clip(candidates, clip_len), F.array(fallback))


def warmup_factor(epoch: Column, epochs: int) -> Column:
    return F.least(F.lit(1.0), (epoch + 1) / F.lit(float(max(epochs, 1))))
