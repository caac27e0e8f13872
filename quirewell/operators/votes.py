"""Ensembles over vote arrays: plurality, thresholds, routing, lookup stackers.

A vote array holds one label per model in a fixed order. All rules are column
expressions, so an ensemble is part of one plan; lookup tables have at most
(labels to the power of models) rows where labels are what they should be, and
are broadcast where a count shows it (``skew.small``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import kept
from .labels import AT, ORDINAL
from .skew import small


def count_of(votes: Column, label) -> Column:
    return F.size(F.filter(votes, lambda v: v == label))


def ordinal(label: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in ORDINAL.items() for x in (F.lit(k), F.lit(v))]), label)


def from_ordinal(rank: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in ORDINAL.items() for x in (F.lit(v), F.lit(k))]), rank)


def upper_median(votes: Column) -> Column:
    """The label at position size div 2 of the votes in ordinal order."""
    ranks = F.array_sort(F.transform(votes, ordinal))
    return from_ordinal(F.get(ranks, F.floor(F.size(ranks) / 2).cast("int")))


def winners(votes: Column) -> Column:
    """The labels with the most votes, in the order in which they first occur."""
    distinct = F.array_distinct(votes)
    top = F.array_max(F.transform(distinct, lambda v: count_of(votes, v)))
    return F.filter(distinct, lambda v: count_of(votes, v) == top)


def plurality(votes: Column, tie: str = "median_of_tied") -> Column:
    """The most frequent label. Ties: the upper median of the tied labels, of
    all votes (if it is among the tied, else the alphabetically first), FALSE
    before others, or the first seen."""
    w = winners(votes)
    if tie == "median_of_tied":
        pick = upper_median(w)
    elif tie == "median_of_all":
        m = upper_median(votes)
        pick = F.when(F.array_contains(w, m), m).otherwise(F.get(F.array_sort(w), F.lit(0)))
    elif tie == "prefer_false":
        pick = F.when(F.array_contains(w, F.lit("FALSE")), F.lit("FALSE")).otherwise(F.get(w, F.lit(0)))
    else:
        pick = F.get(w, F.lit(0))
    return F.when(F.size(w) == 1, F.get(w, F.lit(0))).otherwise(pick)


def strict_majority(votes: Column, label: str = "TRUE", other: str = "FALSE") -> Column:
    return F.when(count_of(votes, label) * 2 > F.size(votes), label).otherwise(other)


def at_least(votes: Column, k: int, label: str = "TRUE", other: str = "FALSE") -> Column:
    return F.when(count_of(votes, label) >= k, label).otherwise(other)


def weighted(votes: Column, weights: list[float], label: str = "TRUE", other: str = "FALSE") -> Column:
    """label if its votes hold more than half of the weight."""
    mass = F.aggregate(F.zip_with(votes, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: F.when(v == label, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(mass * 2 > float(sum(weights)), label).otherwise(other)


def disagreement(votes: Column, models: int) -> dict[str, Column]:
    """Named features of a vote array: fractions, entropy (nats), unanimity, pairwise rate, ordinal spread, modal label."""
    n = F.lit(float(models))
    frac = {x: count_of(votes, x) / n for x in AT}
    ranks = F.transform(votes, ordinal)
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    modal = F.get(winners(votes), F.lit(0))
    entropy = -sum((F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in list(frac.values())[1:]), F.when(frac["TRUE"] > 0, frac["TRUE"] * F.ln(frac["TRUE"])).otherwise(0.0))
    pairs = [(F.get(votes, F.lit(i)) != F.get(votes, F.lit(j))).cast("int") for i in range(models) for j in range(i + 1, models)]
    out = {f"vote_frac_{k}": v for k, v in frac.items()}
    out |= {
        "vote_entropy": entropy,
        "unanimous": (F.size(F.array_distinct(votes)) == 1).cast("double"),
        "pairwise_disagreement": sum(pairs[1:], pairs[0]) / F.lit(float(len(pairs))) if pairs else F.lit(0.0),
        "ordinal_range": (F.array_max(ranks) - F.array_min(ranks)).cast("double"),
        "ordinal_std": F.sqrt(var),
        "bimodal_true_false": (F.array_contains(votes, F.lit("TRUE")) & F.array_contains(votes, F.lit("FALSE")) & ~F.array_contains(votes, F.lit("PROBABLE"))).cast("double"),
        "modal_count": count_of(votes, modal) / n,
        "modal_is_probable": (modal == "PROBABLE").cast("double"),
    }
    for i in range(models):
        v = F.get(votes, F.lit(i))
        out[f"model_{i}_agrees"] = (v == modal).cast("double")
        out[f"model_{i}_ordinal_dist"] = F.abs(ordinal(v) - ordinal(modal)).cast("double")
    return out


def resolve_tie(votes: Column, tied: Column, how: str) -> Column:
    """One of the labels tied in a cell: ordinal_median, last_model, or alphabetical (also where those aren't among the tied)."""
    first = F.get(F.array_sort(tied), F.lit(0))
    if how == "alphabetical":
        return first
    candidate = upper_median(votes) if how == "ordinal_median" else F.element_at(votes, -1)
    return F.when(F.size(tied) == 1, F.get(tied, F.lit(0))).when(F.array_contains(tied, candidate), candidate).otherwise(first)


def cells(df: DataFrame, votes: str, gold: str) -> DataFrame:
    """votes, gold, n over the rows with gold."""
    return df.where(F.col(gold).isNotNull()).groupBy(votes, gold).agg(F.count("*").alias("n"))


def build_lookup(df: DataFrame, votes: str, gold: str, tie: str = "ordinal_median") -> DataFrame:
    """votes, label, n: the mode of gold in each cell of equal votes."""
    c = cells(df, votes, gold).groupBy(votes).agg(F.max("n").alias("top"), F.collect_list(F.struct(F.col(gold).alias("g"), "n")).alias("all"), F.sum("n").alias("n"))
    tied = F.transform(F.filter("all", lambda x: x["n"] == F.col("top")), lambda x: x["g"])
    return c.select(votes, resolve_tie(F.col(votes), tied, tie).alias("label"), "n")


def fallback(votes: Column, how: str = "majority", label: str = "FALSE") -> Column:
    """The rule for votes that the table doesn't hold."""
    w = winners(votes)
    first = F.get(w, F.lit(0))
    agreed = count_of(votes, first) >= 2
    if how == "majority":
        return F.when(agreed, first).otherwise(label)
    if how == "ordinal":
        return F.when(agreed, first).otherwise(F.coalesce(upper_median(votes), F.lit(label)))
    return F.lit(label)


def apply_lookup(df: DataFrame, lookup: DataFrame, votes: str, how: str = "majority", out: str = "stacked") -> DataFrame:
    """df with the looked-up label and whether the cell was seen."""
    table = small(lookup.select(votes, F.col("label").alias("_label")))
    return df.join(table, votes, "left").withColumn("seen", F.col("_label").isNotNull()).withColumn(out, F.coalesce("_label", fallback(F.col(votes), how))).drop("_label")


def leave_one_out(df: DataFrame, votes: str, gold: str, tie: str = "ordinal_median", how: str = "majority", out: str = "stacked") -> DataFrame:
    """The lookup's answer for each row as if the row hadn't been counted: cell counts minus the row's own."""
    c = cells(df, votes, gold).groupBy(votes).agg(F.collect_list(F.struct(F.col(gold).alias("g"), F.col("n").alias("n"))).alias("_all"))
    joined = df.join(small(c), votes, "left")
    own = F.filter(F.transform(F.coalesce("_all", F.array().cast("array<struct<g:string,n:bigint>>")), lambda x: F.struct(x["g"].alias("g"), (x["n"] - F.coalesce((x["g"] == F.col(gold)).cast("bigint"), F.lit(0).cast("bigint"))).alias("n"))), lambda x: x["n"] > 0)
    joined = joined.withColumn("_own", own).withColumn("_top", F.array_max(F.transform("_own", lambda x: x["n"])))
    tied = F.transform(F.filter("_own", lambda x: x["n"] == F.col("_top")), lambda x: x["g"])
    answer = F.when(F.size("_own") > 0, resolve_tie(F.col(votes), tied, tie)).otherwise(fallback(F.col(votes), how))
    return joined.withColumn(out, answer).drop("_all", "_own", "_top")


def binary_ambiguity(p: Column) -> Column:
    """Normalised entropy of (p, 1 - p) times one minus their margin; a term with p <= 1e-9 is left out."""
    q = 1 - p
    term = lambda x: F.when(x > 1e-9, -x * F.ln(x)).otherwise(0.0)
    return (term(p) + term(q)) / F.ln(F.lit(2.0)) * (1 - F.abs(p - q))


def _kth(rows: DataFrame, k: int, n: int, most_local: int, splits: int):
    """The k-th smallest value (from 1) of the struct column ``r`` over n rows, in rounds of counts.

    A round counts the rows between sampled values and keeps the stretch that
    holds the k-th; ties of a score are parted by the keys that follow it in
    the struct. What is left at the end (at most ``most_local`` rows) is ranked.
    """
    fields = rows.schema["r"].dataType.fields

    def literal(v):
        return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, fields)])

    while n > most_local:
        share = min(1.0, 20 * splits / n)
        some = sorted((r.r for r in rows.where(F.rand(7) < share).select("r").collect()), key=lambda v: tuple((x is not None, x) for x in v))
        marks = list(dict.fromkeys(tuple(v) for v in some[:: max(1, len(some) // splits)]))
        place = F.size(F.filter(F.array(*[literal(m) for m in marks]), lambda m: m < F.col("r")))
        counts = {r[0]: r[1] for r in rows.groupBy(place.alias("p")).count().collect()}  # at most ``splits`` rows
        for p in sorted(counts):
            if k <= counts[p]:
                break
            k -= counts[p]
        if counts[p] == n:  # nothing parts them: all rows are equal
            break
        bounds = [F.col("r") > literal(marks[p - 1])] if p else []
        bounds += [F.col("r") <= literal(marks[p])] if p < len(marks) else []
        for b in bounds:
            rows = rows.where(b)
        n = counts[p]
    w = Window.orderBy("r")
    return literal(rows.withColumn("i", F.row_number().over(w)).where(F.col("i") == k).first().r)


def top_share(df: DataFrame, score: str, share: float, keys: list[str], ascending: bool = False, out: str = "routed", most_local: int = 200_000, splits: int = 200) -> DataFrame:
    """df with whether a row is among the round(share * n) rows of highest (or lowest) score; ties by key, unknown scores last.

    The rank is global, but no task sorts all rows or all ties: the last row
    inside is found by counts (``_kth``) over a slim table of scores and keys,
    and every row is compared with it.
    """
    value = F.col(score).cast("double")
    value = F.when(value.isNull() | F.isnan(value), F.lit(float("inf"))).otherwise(value if ascending else -value)
    rank = F.struct(value.alias("s"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    slim = kept(df.select(rank.alias("r")))
    n = slim.count()
    k = int(round(share * n))
    inside = F.lit(k > 0) if k <= 0 or k >= n else rank <= _kth(slim, k, n, most_local, splits)
    return df.withColumn(out, inside)
