"""Subgroup mining over interval patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .sampling import by_hash

Pattern = dict[str, tuple[float, float]]


def matches(pattern: Pattern) -> Column:
    """Whether a row lies in all of the pattern's closed intervals; unknown values don't."""
    out = F.lit(True)
    for name, (lo, hi) in pattern.items():
        out = out & F.coalesce(F.col(name).between(lo, hi), F.lit(False))
    return out


def matches_any(patterns: list[Pattern]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(p)
    return out


def with_flags(df: DataFrame, patterns: list[Pattern], prefix: str = "sd_") -> DataFrame:
    """df with one column of 0.0 or 1.0 per pattern."""
    return df.withColumns({f"{prefix}{i}": matches(p).cast("double") for i, p in enumerate(patterns)})


def describe(pattern: Pattern) -> str:
    return " AND ".join(f"{k} in [{lo:.3g}, {hi:.3g}]" for k, (lo, hi) in sorted(pattern.items()))


def nwracc(s: Column, pos: Column, n: Column, n_pos: Column) -> Column:
    """(s/n) (pos/s - p) / (p (1 - p)); 0 where undefined."""
    p = n_pos / n
    return F.coalesce(F.try_divide((s / n) * (F.try_divide(pos, s) - p), p * (1 - p)), F.lit(0.0))


def evaluate(df: DataFrame, patterns: list[Pattern], positive: Column) -> DataFrame:
    """pattern_id, support, support_pos, precision, recall, nwracc: all patterns in one aggregation."""
    hit = F.coalesce(positive, F.lit(False))
    sums = [x for i, p in enumerate(patterns) for x in (F.count_if(matches(p)).alias(f"s{i}"), F.count_if(matches(p) & hit).alias(f"p{i}"))]
    one = df.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_pos"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.col(f"s{i}").alias("support"), F.col(f"p{i}").alias("support_pos")) for i in range(len(patterns))]))
    t = one.select("n", "n_pos", rows.alias("e")).select("n", "n_pos", "e.*")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return t.select("pattern_id", "support", "support_pos", ratio(F.col("support_pos"), F.col("support")).alias("precision"), ratio(F.col("support_pos"), F.col("n_pos")).alias("recall"), F.round(nwracc(F.col("support"), F.col("support_pos"), F.col("n"), F.col("n_pos")), 6).alias("nwracc"))


def gated(evaluated: DataFrame, least_nwracc: float = 0.0, least_precision: float = 0.0, least_support: int = 1) -> DataFrame:
    """The rows of ``evaluate`` that pass the quality gates."""
    return evaluated.where((F.col("nwracc") >= least_nwracc) & (F.col("precision") >= least_precision) & (F.col("support") >= least_support))


def overridden(df: DataFrame, label: str, history: str, hit: Column, to: str, **about: str) -> DataFrame:
    """df with ``label`` set to ``to`` where ``hit``, and the change appended to what ``history`` (array<struct>, may be null) holds already."""
    change = F.struct(F.col(label).alias("from"), F.lit(to).alias("to"), *[F.lit(v).alias(k) for k, v in about.items()])
    before = F.coalesce(history, F.array().cast(df.schema[history].dataType))
    changes = F.coalesce(hit, F.lit(False)) & (F.col(label) != to)
    return df.withColumns({history: F.when(changes, F.array_append(before, change)).otherwise(before), label: F.when(changes, F.lit(to)).otherwise(F.col(label))})


def close_on_positive(df: DataFrame, pattern: Pattern, features: list[str], positive: Column) -> DataFrame:
    """feature, lo, hi: the tightest intervals around the positives inside the pattern."""
    inside = df.where(matches(pattern) & F.coalesce(positive, F.lit(False)))
    one = inside.agg(*[x for f in features for x in (F.min(f).cast("double").alias(f"lo_{f}"), F.max(f).cast("double").alias(f"hi_{f}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi")) for f in features])).alias("e")).select("e.*")


def meet(df: DataFrame, features: list[str], key: str, a, b) -> DataFrame:
    """feature, lo, hi: the smallest box around two rows."""
    two = df.where(F.col(key).isin(a, b))
    return close_on_positive(two, {}, features, F.lit(True))


def vacuous(bounds: DataFrame, df: DataFrame, features: list[str], eps: float = 1e-6) -> DataFrame:
    """The rows (pattern_id, feature, lo, hi) of ``bounds`` that restrict anything, given the data's ranges."""
    ranges = close_on_positive(df, {}, features, F.lit(True)).select("feature", F.col("lo").alias("least"), F.col("hi").alias("most"))
    t = bounds.join(F.broadcast(ranges), "feature")  # one row per feature
    return t.where(~((F.col("lo") <= F.col("least") + eps) & (F.col("hi") >= F.col("most") - eps))).select(*bounds.columns)


def discover(df: DataFrame, features: list[str], positive: str, chains: int = 8, steps: int = 400, most_rows: int = 50_000, seed: int = 42, tightness: float = 8.0) -> DataFrame:
    """chain, nwracc, support, support_pos, lo (array), hi (array), active (array): the best box of each annealed chain.

    A chain starts from the box of two positives and walks by tightening,
    loosening, dropping and adding intervals, keeping boxes closed on the
    positives. Chains are rows of a range, each a task; they share a sample of
    at most ``most_rows`` rows (by hash), broadcast for that bound. The boxes
    they end with are closed on the positives of all rows, and nwracc, support
    and support_pos are those of ``evaluate`` over all rows.
    """
    spark = df.sparkSession
    every = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(positive).cast("boolean").alias("y")).dropna()
    rows = by_hash(every, [*features, "y"], most_rows).toPandas()
    x, y = rows[features].to_numpy(), rows["y"].to_numpy()
    shared = spark.sparkContext.broadcast((x, y))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = shared.value
        n, k = x.shape if len(x) else (0, len(features))
        share = y.mean() if n else 0.0
        for batch in batches:
            out = []
            for chain in batch["id"].tolist():
                if not n or not 0 < share < 1:
                    continue
                rng = np.random.default_rng(seed + chain)

                def score(lo, hi, active):
                    m = np.ones(n, bool)
                    for j in np.flatnonzero(active):
                        m &= (x[:, j] >= lo[j]) & (x[:, j] <= hi[j])
                    s = m.sum()
                    return ((s / n) * ((y[m].mean() if s else 0) - share) / (share * (1 - share)) if s else -1.0), m

                def closed(lo, hi, active, m):
                    p = x[m & y]
                    if len(p):
                        lo, hi = lo.copy(), hi.copy()
                        for j in np.flatnonzero(active):
                            lo[j], hi[j] = p[:, j].min(), p[:, j].max()
                    return lo, hi

                pos = x[y]
                a, b = pos[rng.integers(len(pos), size=2)]
                lo, hi, active = np.minimum(a, b), np.maximum(a, b), rng.random(k) < 0.7
                if not active.any():
                    active[rng.integers(k)] = True
                value, m = score(lo, hi, active)
                best = (value, lo, hi, active, m)
                for step in range(steps):
                    heat = 0.1 * (1 - step / steps) + 1e-3
                    lo2, hi2, on = lo.copy(), hi.copy(), active.copy()
                    j = int(rng.integers(k))
                    move = rng.random()
                    if move < 0.25 and on.sum() > 1:
                        on[j] = False
                    elif move < 0.5 and not on[j]:
                        on[j] = True
                    else:
                        p = pos[rng.integers(len(pos))]
                        lo2[j], hi2[j] = (min(lo2[j], p[j]), max(hi2[j], p[j])) if rng.random() < 0.6 else (max(lo2[j], min(p[j], hi2[j])), hi2[j])
                    if not on.any():
                        continue
                    v, m2 = score(lo2, hi2, on)
                    lo2, hi2 = closed(lo2, hi2, on, m2)
                    v, m2 = score(lo2, hi2, on)
                    if v >= value or rng.random() < np.exp((v - value) / heat):
                        lo, hi, active, value = lo2, hi2, on, v
                        if v > best[0]:
                            best = (v, lo2, hi2, on, m2)
                _, lo_, hi_, on, _ = best
                out.append((chain, lo_.tolist(), hi_.tolist(), on.tolist()))
            yield pd.DataFrame(out, columns=["chain", "lo", "hi", "active"])

    boxes = spark.range(chains, numPartitions=chains).mapInPandas(walk, "chain bigint, lo array<double>, hi array<double>, active array<boolean>").orderBy("chain").collect()
    ends = _closed_boxes(every, features, [{f: (lo, hi) for f, lo, hi, on in zip(features, b.lo, b.hi, b.active) if on} for b in boxes])
    bounds = [(i, b.chain, *[[p[f][j] if f in p else v for f, v in zip(features, (b.lo, b.hi)[j])] for j in (0, 1)], b.active) for i, (b, p) in enumerate(zip(boxes, ends))]
    t = spark.createDataFrame(bounds, "pattern_id int, chain bigint, lo array<double>, hi array<double>, active array<boolean>")
    if not ends:
        return t.select("chain", F.lit(0.0).alias("nwracc"), *[F.lit(0).cast("bigint").alias(c) for c in ("support", "support_pos")], "lo", "hi", "active")
    return evaluate(every, ends, F.col("y")).join(F.broadcast(t), "pattern_id").select("chain", "nwracc", "support", "support_pos", "lo", "hi", "active")


def _closed_boxes(df: DataFrame, features: list[str], patterns: list[Pattern]) -> list[Pattern]:
    """Each pattern closed on the rows of ``df`` where y holds, in one aggregation; as it is if it has none."""
    if not patterns:
        return []
    inside = [(i, f, F.when(matches(p) & F.col("y"), F.col(f))) for i, p in enumerate(patterns) for f in p]
    one = df.agg(*[x for i, f, v in inside for x in (F.min(v).alias(f"lo_{i}_{f}"), F.max(v).alias(f"hi_{i}_{f}"))]).first()
    return [{f: bounds if one[f"lo_{i}_{f}"] is None else (one[f"lo_{i}_{f}"], one[f"hi_{i}_{f}"]) for f, bounds in p.items()} for i, p in enumerate(patterns)]


def overlaps(df: DataFrame, patterns: list[Pattern]) -> np.ndarray:
    """How alike the extents of the patterns are over all rows (Jaccard), from counts in one aggregation; no extent leaves its rows."""
    n = len(patterns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    one = df.agg(*[F.count_if(matches(patterns[i]) & matches(patterns[j])).alias(f"c{i}_{j}") for i, j in pairs]).first() if n else {}
    both = np.zeros((n, n))
    for i, j in pairs:
        both[i, j] = both[j, i] = one[f"c{i}_{j}"]
    union = both.diagonal()[:, None] + both.diagonal()[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def fold_stability(df: DataFrame, features: list[str], positive: str, key: str, folds: int = 5, least_precision: float = 0.3, least_folds: int = 3, alike: float = 0.5, **options) -> tuple[DataFrame, DataFrame]:
    """(stable descriptions, stable clusters) of boxes found in each of ``folds`` training parts.

    Boxes are found without a fold and evaluated on it. A description is
    stable if it passes ``least_precision`` on ``least_folds`` folds; a cluster
    of boxes whose extents over all rows are ``alike`` is stable if its members
    pass on that many. A box stands for one row of the driver: chains times
    folds at most.
    """
    from .sampling import stratified_folds

    spark = df.sparkSession
    t = stratified_folds(df.withColumn("_y", F.coalesce(F.col(positive), F.lit(False)).cast("string")), key, ["_y"], folds)
    found: list[tuple] = []  # fold, pattern, nwracc in training, precision, recall held out
    for fold in range(folds):
        boxes = discover(t.where(F.col("fold") != fold), features, positive, seed=42 + fold, **options).collect()
        patterns, seen = [], set()
        for b in sorted(boxes, key=lambda b: -b.nwracc):
            p = {f: (lo, hi) for f, lo, hi, on in zip(features, b.lo, b.hi, b.active) if on}
            if describe(p) not in seen:
                seen.add(describe(p))
                patterns.append((p, b.nwracc))
        held = {r.pattern_id: r for r in evaluate(t.where(F.col("fold") == fold), [p for p, _ in patterns], F.col(positive)).collect()} if patterns else {}
        found += [(fold, p, score, held[i].precision, held[i].recall) for i, (p, score) in enumerate(patterns)]
    mean = lambda rows, i: round(float(np.mean([r[i] for r in rows])), 6)
    named: dict[str, list] = {}
    for r in found:
        named.setdefault(describe(r[1]), []).append(r)
    strings = [(name, n, len(rows), mean(rows, 3), mean(rows, 4)) for name, rows in named.items() if (n := sum(r[3] >= least_precision for r in rows)) >= least_folds]
    near = overlaps(df, [r[1] for r in found])
    firsts: list[int] = []
    members: dict[int, list[int]] = {}
    for i in range(len(found)):
        lead = next((c for c in firsts if near[i, c] >= alike), i)
        if lead == i:
            firsts.append(i)
        members.setdefault(lead, []).append(i)
    clusters = []
    for ids in members.values():
        rows = [found[i] for i in ids]
        good = {r[0] for r in rows if r[3] >= least_precision}
        if len(good) >= least_folds:
            best = max(rows, key=lambda r: r[3])
            clusters.append((describe(best[1]), len(rows), len({r[0] for r in rows}), len(good), mean(rows, 3), mean(rows, 4), mean(rows, 2)))
    strings.sort(key=lambda r: (-r[1], -r[3], r[0]))
    clusters.sort(key=lambda r: (-r[3], -r[4], r[0]))
    return (
        spark.createDataFrame(strings, "pattern string, folds_stable int, folds_seen int, precision double, recall double"),
        spark.createDataFrame(clusters, "representative string, members int, folds_seen int, folds_stable int, precision double, recall double, nwracc double"),
    )


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def non_redundant(candidates: list[tuple[str, float, set]], theta: float = 0.5, top: int = 10) -> list[int]:
    """Indices of the best candidates (description, score, extent), none overlapping a better one by more than theta."""
    kept: list[int] = []
    seen: set[str] = set()
    for i in sorted(range(len(candidates)), key=lambda i: (-candidates[i][1], candidates[i][0])):
        name, _, extent = candidates[i]
        if name in seen or any(jaccard(extent, candidates[j][2]) > theta for j in kept):
            continue
        seen.add(name)
        kept.append(i)
        if len(kept) == top:
            break
    return kept


def leaders(extents: list[set], threshold: float) -> list[int]:
    """Leader clustering: each extent joins the first cluster whose first member it resembles enough."""
    firsts: list[set] = []
    out = []
    for e in extents:
        for c, first in enumerate(firsts):
            if jaccard(e, first) >= threshold:
                out.append(c)
                break
        else:
            out.append(len(firsts))
            firsts.append(e)
    return out
