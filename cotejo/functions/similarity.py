"""Similarities of token and letter sets as Column functions (SIM3-6, SIM9-10, SIM13, ST3-4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def token_jaccard(a: Column, b: Column) -> Column:
    """SIM3 and SIM4, by the tokens given: 0 if a side has none."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def tokens_subset(a: Column, b: Column) -> Column:
    """ST4: the shorter list's tokens are all in the longer one, and there are some."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return (F.size(short) > 0) & (F.size(F.array_except(short, long)) == 0)


def bigrams(text: Column) -> Column:
    """Two-letter pieces, each numbered among its equals, so that set operations act on the bag."""
    pieces = F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))
    return let(pieces, lambda p: F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, F.lit(1), i), lambda y: y == x)).cast("string"))))


def bigram_dice(a: Column, b: Column) -> Column:
    """SIM5: 1 for equal texts, 0 if one has under 2 letters."""
    both = F.size(F.array_intersect(bigrams(a), bigrams(b)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * both / (F.length(a) + F.length(b) - 2))


def best_word_pair(a: Column, b: Column) -> Column:
    """SIM6: the mean over a's words of 3 and more of their best Dice among b's. Not symmetric."""


    def words(x: Column) -> Column:
        """Words of 3 and more with their bigrams."""
        return F.transform(F.filter(x, lambda w: F.length(w) >= 3), lambda w: F.struct(w.alias("w"), bigrams(w).alias("g")))

    def dice(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x["g"], y["g"]))
        return F.when(x["w"] == y["w"], 1.0).otherwise(2.0 * both / (F.size(x["g"]) + F.size(y["g"])))

    def mean(own: Column, other: Column) -> Column:
        best = F.transform(own, lambda x: F.coalesce(F.array_max(F.transform(other, lambda y: dice(x, y))), F.lit(0.0)))
        return F.when(F.size(own) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(own))

    return let(words(a), lambda own: let(words(b), lambda other: mean(own, other)))


def dedup_combined(title: Column, author: Column) -> Column:
    return title * 0.65 + author * 0.35


def dedup_tier(title: Column, author: Column) -> Column:
    """SIM9: exact, muy_similar, posiblemente_similar or null."""
    combined = dedup_combined(title, author)
    return F.when((title >= 0.99) & (author >= 0.95), "exact").when(combined >= 0.90, "muy_similar").when(combined >= 0.75, "posiblemente_similar")


def percent(score: Column) -> Column:
    """SIM10: half up."""
    return F.floor(score * 100 + 0.5).cast("int")


def verify_combined(title: Column, author: Column) -> Column:
    """SIM13."""
    return title * 0.55 + author * 0.45
