"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(ZERO), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(ZERO), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """v over its length; null elements for the zero vector."""
    return F.transform(doubles(v), lambda x: x / F.nullif(norm(v), F.lit(ZERO)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    return F.coalesce(dot(doubles(a), doubles(b)) / F.nullif(norm(a) * norm(b), F.lit(ZERO)), F.lit(ZERO))


def fold_layers(layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[list[float], float]:
    """Weights and bias of a chain of linear layers without activations, as one affine map to a single output.

    A layer is (matrix of outputs x inputs, bias). Dropout is the identity when a
    network is evaluated, so such a network never needs Python on an executor.
    """
    weight, bias = None, None
    for w, b in layers:
        w, b = np.asarray(w, np.float64), np.asarray(b, np.float64)
        weight, bias = (w, b) if weight is None else (w @ weight, w @ bias + b)
    if weight is None or weight.shape[0] != 1:
        raise ValueError("the last layer must have one output")
    return weight[0].tolist(), float(bias[0])


def affine(v: Column, weights: Sequence[float], bias: float) -> Column:
    return dot(doubles(v), F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))
