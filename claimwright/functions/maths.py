"""Two-class softmax, losses and penalties as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimwright import constants as K


def log_sum_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def log_prob(logit0: Column, logit1: Column, cls: Column) -> Column:
    """Log-probability of class ``cls``."""
    return F.when(cls == 1, logit1).otherwise(logit0) - log_sum_exp(logit0, logit1)


def predicted_class(logit0: Column, logit1: Column) -> Column:
    """Class with the larger logit; a tie goes to class 0."""
    return F.when(logit1 > logit0, 1).otherwise(0).cast("int")


def confidence(logit0: Column, logit1: Column) -> Column:
    return F.exp(log_prob(logit0, logit1, predicted_class(logit0, logit1)))


def cross_entropy(logit0: Column, logit1: Column, label: Column) -> Column:
    return -log_prob(logit0, logit1, label)


def smoothed_cross_entropy(
    logit0: Column, logit1: Column, label: Column, smoothing: float = K.SMOOTHING
) -> Column:
    """Soft targets: ``1 - s`` on the label, ``s`` on the other class."""
    return (1 - smoothing) * cross_entropy(logit0, logit1, label) + smoothing * cross_entropy(
        logit0, logit1, 1 - label
    )


def focal_loss(
    logit0: Column, logit1: Column, label: Column, weight: Column, gamma: float = K.FOCAL_GAMMA
) -> Column:
    ce = weight * cross_entropy(logit0, logit1, label)
    return F.pow(1 - F.exp(-ce), gamma) * ce
