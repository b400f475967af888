"""Vector expressions on array columns. They run in the JVM, once per row: use them on given pairs of
vectors; the all-against-all forms are in `versionlake.operators.tiles`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DISTANCE_MODES = ("cos", "cossim", "dot", "dotsim", "euc", "neuc", "sqeuc", "nsqeuc", "fro", "nfro")


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(as_double(a), lambda x: x * x)))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    """Unit vector; a norm below `eps` counts as `eps`, so a zero vector stays zero.

    The norm is bound to a variable first: written inside the inner lambda it would be computed again for
    every element.
    """
    size = F.greatest(norm(a), F.lit(eps))
    return F.element_at(
        F.transform(F.array(size), lambda n: F.transform(as_double(a), lambda x: x / n)), 1)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def distance(a: Column, b: Column, mode: str = "fro", p: float = 2.0, eps: float = 1e-6) -> Column:
    """Distance (or similarity, for the `sim` modes) of two vectors under one of `DISTANCE_MODES`."""
    if mode in ("cos", "cossim"):
        value = dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
        return 1 - value if mode == "cos" else value
    if mode in ("dot", "dotsim"):
        return 1 - dot(a, b) if mode == "dot" else dot(a, b)
    if mode in ("sqeuc", "nsqeuc"):
        value = F.greatest(
            _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))), F.lit(0.0))
        return value / F.size(a) if mode == "nsqeuc" else value
    if mode in ("fro", "nfro", "euc", "neuc"):
        power = 2.0 if mode in ("euc", "neuc") else float(p)
        value = F.pow(
            _total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.pow(F.abs(x - y), F.lit(power)))),
            F.lit(1.0 / power))
        return value / F.pow(F.size(a).cast("double"), F.lit(1.0 / power)) if mode in ("nfro", "neuc") else value
    raise ValueError(f"unknown distance mode: {mode}")
