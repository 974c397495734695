"""Column -> Column vector functions over ``array<float>`` embeddings.

These are the Catalyst (array-lambda) forms: exact, JVM-side, row at a time.
The bulk nearest-neighbour path (many queries x many rows) lives in
``semsift.operators.knn`` and uses Arrow batches instead.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions.util import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product accumulated in double, left to right."""
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v) -> Column:
    """Euclidean norm in double."""
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0).cast("double"),
                              lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    """Unit-length copy; a zero vector is returned unchanged."""
    def scale(n):
        return F.when(n > 0, F.transform(_col(v), lambda x: (x.cast("double") / n).cast("float"))
                      ).otherwise(_col(v))
    return let(norm(v), scale)


def quantize(v, decimals: int = C.VECTOR_DECIMALS) -> Column:
    """Round every component to ``decimals`` places, half-even, back to float."""
    return F.transform(_col(v), lambda x: F.bround(x.cast("double"), decimals).cast("float"))


def cosine_distance(a, b) -> Column:
    """``1 - cos(a, b)``, similarity clamped to [-1, 1]; NULL when a norm is 0."""
    na, nb = norm(a), norm(b)
    sim = dot(a, b) / (na * nb)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sim))
    return F.when((na > 0) & (nb > 0), F.lit(1.0) - clamped)


def knn_score(distance) -> Column:
    """Similarity score ``1 / (1 + distance)`` in [1/3, 1]."""
    return F.lit(1.0) / (F.lit(1.0) + _col(distance))
