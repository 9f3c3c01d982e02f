"""Term weights and association scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(num_articles: Column, n_articles: Column) -> Column:
    return F.ln((1 + n_articles) / (1 + num_articles))


def tfidf(tf: Column, idf_: Column) -> Column:
    return tf * idf_


def ridf(cf: Column, df: Column, n_articles: Column) -> Column:
    """Residual IDF: observed IDF beyond what a Poisson model of `cf` occurrences predicts."""
    return F.log2(n_articles / df) + F.log2(1 - F.exp(-cf / n_articles))


def scale_ridf(ridf_: Column, low: Column, high: Column) -> Column:
    """Shift by |minimum| and divide by the shifted maximum; undefined when that is zero."""
    return F.try_divide(ridf_ + F.abs(low), high + F.abs(low))


def weigh_by_articles(scaled: Column, num_articles: Column, max_articles: Column) -> Column:
    """Scaled RIDF weighted by the relative log number of articles, before the last normalisation."""
    return scaled * F.try_divide(F.ln(num_articles + 1), F.ln(max_articles + 1))


def phi(n: Column, both: Column, count1: Column, count2: Column) -> Column:
    """Pearson correlation of two presence columns over `n` articles; null when one is constant."""
    n, both, a, b = (c.cast("double") for c in (n, both, count1, count2))
    return F.try_divide(n * both - a * b, F.sqrt(a * (n - a)) * F.sqrt(b * (n - b)))


def exact_sum(share: Column) -> Column:
    """Sum of numbers from 0 to 1 in units of 2^-60, the same whatever the order of the rows.

    The first 30 and the next 30 binary digits are summed as integers, which has room for 8 billion rows.
    """
    high = F.floor(share * float(1 << 30))
    low = F.floor((share * float(1 << 30) - high) * float(1 << 30))
    return F.sum(high) / float(1 << 30) + F.sum(low) / float(1 << 60)
