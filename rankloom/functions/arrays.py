"""Vector column expressions on ``ARRAY<DOUBLE|FLOAT>``."""

from pyspark.sql import Column, functions as F

from .text import bind


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    return bind(
        vector,
        lambda v: bind(
            norm(v),
            lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
        ),
    )


