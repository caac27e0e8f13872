"""Scores of predicted against gold labels, as plain aggregations.

Every function takes ``by``, the grouping columns, so one model, many models,
languages or splits are scored in one job. Recalls use partial aggregation
over (group, label) and never shuffle rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .labels import null_to_false

ROUND = 6


def _counts(df: DataFrame, gold: Column, pred: Column, by: list[str]) -> DataFrame:
    """by, gold, pred, n after null became FALSE; the only pass over the rows."""
    return df.groupBy(*by, null_to_false(gold).alias("gold"), null_to_false(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...], by: list[str]) -> DataFrame:
    """by, gold, pred, n over the label set; labels outside it are ignored."""
    return _counts(df, F.col(gold), F.col(pred), by).where(F.col("gold").isin(*labels) & F.col("pred").isin(*labels))


def recalls(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...], by: list[str]) -> DataFrame:
    """by, label, support, hits, recall (null without support)."""
    c = _counts(df, F.col(gold), F.col(pred), by)
    per = c.groupBy(*by).agg(*[F.sum(F.when(F.col("gold") == x, F.col("n")).otherwise(0)).alias(f"s_{x}") for x in labels], *[F.sum(F.when((F.col("gold") == x) & (F.col("pred") == x), F.col("n")).otherwise(0)).alias(f"h_{x}") for x in labels])
    entries = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"s_{x}").alias("support"), F.col(f"h_{x}").alias("hits")) for x in labels])
    return per.select(*by, F.explode(entries).alias("e")).select(*by, "e.*", F.round(F.try_divide("e.hits", "e.support"), ROUND).alias("recall"))


def macro_recall(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...], by: list[str], out: str = "macro_recall") -> DataFrame:
    """by, macro recall over labels with support (0.0 if none has any), n, n_gold_null."""
    nulls = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(gold).isNull()).alias("n_gold_null"))
    c = _counts(df, F.col(gold), F.col(pred), by).where(F.col("gold").isin(*labels))
    each = c.groupBy(*by, "gold").agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    mean = each.groupBy(*by).agg(F.avg("r").alias("m"))
    joined = nulls.join(mean, by, "left") if by else nulls.crossJoin(mean)  # one row each
    return joined.select(*by, F.round(F.coalesce("m", F.lit(0.0)), ROUND).alias(out), "n", "n_gold_null")


def global_score(df: DataFrame, targets: list[tuple[str, str, tuple[str, ...]]], by: list[str]) -> DataFrame:
    """by, one macro recall per target, and their mean."""
    out = None
    for i, (gold, pred, labels) in enumerate(targets):
        m = macro_recall(df, gold, pred, labels, by, f"mr_{i}").select(*by, f"mr_{i}")
        out = m if out is None else out.join(m, by)
    total = sum((F.col(f"mr_{i}") for i in range(1, len(targets))), F.col("mr_0"))
    return out.withColumn("global_score", F.round(total / len(targets), ROUND))


def class_report(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...], by: list[str]) -> DataFrame:
    """by, label, precision, recall, f1, support; undefined ratios are 0."""
    c = _counts(df, F.col(gold), F.col(pred), by)
    tagged = c.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col("gold") == x).alias("g"), (F.col("pred") == x).alias("p")) for x in labels])).alias("e"))
    t = tagged.groupBy(*by, "e.label").agg(
        F.sum(F.when(F.col("e.g") & F.col("e.p"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("e.p"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("e.g"), F.col("n")).otherwise(0)).alias("support"),
    )
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return t.select(*by, "label", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support")


def averages(report: DataFrame, by: list[str]) -> DataFrame:
    """by, macro averages over labels with support and averages weighted by support."""
    has = F.col("support") > 0
    macro = [F.round(F.coalesce(F.avg(F.when(has, F.col(c))), F.lit(0.0)), ROUND).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.round(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)), ROUND).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.groupBy(*by).agg(*macro, *weighted)


def kappa(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...], by: list[str]) -> DataFrame:
    """by, accuracy, Cohen's kappa (0 where chance agreement is complete)."""
    c = confusion(df, gold, pred, labels, by)
    wide = c.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"), *[F.sum(F.when(F.col(side) == x, F.col("n")).otherwise(0)).alias(f"{side}_{x}") for side in ("gold", "pred") for x in labels])
    po = F.col("same") / F.col("n")
    pe = sum((F.col(f"gold_{x}") * F.col(f"pred_{x}") for x in labels[1:]), F.col(f"gold_{labels[0]}") * F.col(f"pred_{labels[0]}")) / (F.col("n") * F.col("n"))
    return wide.select(*by, F.round(po, 4).alias("accuracy"), F.round(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)), 4).alias("kappa"))


def joint_cells(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, the label combination, n: at most as many rows as label combinations."""
    return df.groupBy(*by, *[null_to_false(F.col(c)).alias(c) for c in columns]).agg(F.count("*").alias("n"))


def bootstrap(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...], by: list[str], replicates: int = 1000, seed: int = 42, ci: float = 0.95, quantile: str = "linear") -> DataFrame:
    """by, point, lo, hi of the macro recall.

    Rows are only counted: a resample of n rows is a multinomial draw over the
    few joint cells, so replicates cost nothing of the data's size. ``quantile``
    is ``linear`` (interpolated) or ``index`` (the sorted value at int(q * B)).
    """
    import numpy as np
    import pandas as pd

    cells = joint_cells(df, [gold, pred], by)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p, n = pdf[gold].to_numpy(), pdf[pred].to_numpy(), pdf["n"].to_numpy()
        rng = np.random.default_rng(seed)
        order = np.lexsort((p.astype(str), g.astype(str)))
        g, p, n = g[order], p[order], n[order]
        draws = rng.multinomial(n.sum(), n / n.sum(), size=replicates)

        def score(counts: np.ndarray) -> np.ndarray:
            parts = []
            for x in labels:
                support = counts[:, g == x].sum(axis=1)
                hits = counts[:, (g == x) & (p == x)].sum(axis=1)
                parts.append(np.where(support > 0, hits / np.maximum(support, 1), np.nan))
            m = np.array(parts)
            have = (~np.isnan(m)).sum(axis=0)
            return np.where(have > 0, np.nansum(m, axis=0) / np.maximum(have, 1), 0.0)

        values = np.sort(score(draws))
        a, b = (1 - ci) / 2, 1 - (1 - ci) / 2
        if quantile == "linear":
            lo, hi = np.quantile(values, [a, b])
        else:
            lo, hi = values[int(a * replicates)], values[min(int(b * replicates), replicates - 1)]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "point": float(score(n[None, :])[0]), "lo": float(lo), "hi": float(hi)}])

    kinds = dict(df.dtypes)
    return cells.groupBy(*by).applyInPandas(draw, ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["point double", "lo double", "hi double"]))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """nmi of two discrete columns, with the arithmetic mean of the entropies as its base."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    ma, mb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    joined = cells.join(ma, "a").join(mb, "b").crossJoin(total)  # total is one row
    mi = F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))))
    entropy = lambda t, c: t.crossJoin(total).agg((-F.sum(F.col(c) / F.col("total") * F.ln(F.col(c) / F.col("total")))).alias("h"))
    ha, hb = entropy(ma, "na").withColumnRenamed("h", "ha"), entropy(mb, "nb").withColumnRenamed("h", "hb")
    return joined.agg(mi.alias("mi")).crossJoin(ha).crossJoin(hb).select(F.round(F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(0.0)), ROUND).alias("nmi"))
