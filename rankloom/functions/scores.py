"""Numeric column expressions: document quality scores and BM25 parts."""

from pyspark.sql import Column, functions as F

# Fixed values of the scoring formulas.
MAX_STARS = 10000.0
MAX_VIEWS = 100000.0
STAR_WEIGHT = 0.7
VIEW_WEIGHT = 0.3
DECAY_DAYS = 365.0
K1 = 1.2
B = 0.75


def _share(count: Column, full: float) -> Column:
    # least() skips nulls, but a null count must give a null score
    return F.when(count.isNotNull(), F.least(count / F.lit(full), F.lit(1.0)))


def norm_stars(stars: Column) -> Column:
    """Star count on a 0-1 scale, full at 10,000; nothing clamps below."""
    return _share(stars, MAX_STARS)


def norm_views(views: Column) -> Column:
    """View count on a 0-1 scale, full at 100,000."""
    return _share(views, MAX_VIEWS)


def popularity(stars: Column, views: Column) -> Column:
    """Weighted popularity; null when either count is null."""
    return F.lit(STAR_WEIGHT) * norm_stars(stars) + F.lit(VIEW_WEIGHT) * norm_views(views)


def age_days(moment: Column, as_of: Column) -> Column:
    """Whole days from ``moment`` to ``as_of``, rounded down (negative for the future)."""
    micros = F.unix_micros(as_of) - F.unix_micros(moment)
    return F.floor(micros / F.lit(86_400_000_000))


def freshness(modified: Column, as_of: Column) -> Column:
    """Exponential decay over a year; null for a future or missing moment."""
    age = age_days(modified, as_of)
    return F.when(age >= 0, F.exp(-age / F.lit(DECAY_DAYS)))


def idf(n_docs: Column, df: Column) -> Column:
    """BM25 inverse document frequency."""
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, length_ratio: Column) -> Column:
    """BM25 term saturation; a field without stored lengths has a null ratio, taken as 1."""
    ratio = F.coalesce(length_ratio, F.lit(1.0))
    return tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * ratio))
