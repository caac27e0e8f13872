"""The most similar vectors for every vector, by robust-pruned directed graphs.

1. Vectors that can't be compared (null, wrong length, all zero, not finite)
   take no part. Identical vectors become one, so copies never crowd a graph.
2. A bounded sample (``most_fit`` vectors, by hash) yields centroids; every
   vector goes to the cell of its nearest one. A cell above ``most_shard`` is
   divided once more, by centroids fitted to a sample of its own (``Cells``).
   The final cells are the shards: some ``shard`` vectors each.
3. Each shard builds its graph: points are inserted in growing batches, a
   greedy beam search over the graph so far proposes neighbours, relaxed
   distance pruning keeps diverse edges, and reverse edges are pruned alike.
4. Beam search answers each vector in its own shard, starting from itself. A
   vector near the border of other shards also queries those: within the
   distance that ``least`` allows, a neighbour across a border whose direction
   is unrelated to the border's is missed with the odds of ``reach`` standard
   deviations. Similarities are checked exactly (double precision).

Ties go to the smaller id. Null ids are not compared; empty input gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import split_join
from ..session import cut, kept


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors; deterministic."""
    if len(x) <= k:
        return x.copy()
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c).astype(np.float32)
    return c


def beam(x: np.ndarray, edges: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int, step: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), each (queries, width), best first; -1 where the graph holds fewer.

    All queries advance together: each expands its ``step`` best unexpanded
    points, until none of its ``width`` best is unexpanded.
    """
    n, b = len(x), len(q)
    seen = np.full(b * n, -1, np.int32)  # the place in its round at which a query met a point
    rows = np.repeat(np.arange(b), starts.shape[1])
    flat = starts.ravel()
    ids = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -9.0, np.float32)
    fresh = np.zeros((b, width), dtype=bool)
    active = np.arange(b)
    cand, crow, cols = flat, rows, starts.shape[1]
    while len(active):
        # ---- the new points of this round: (crow: position in active, cand: point), -1 for none
        ok = cand >= 0
        crow, cand = crow[ok], cand[ok]
        key = active[crow].astype(np.int64) * n + cand
        new = seen[key] < 0
        crow, cand, key = crow[new], cand[new], key[new]
        place = np.arange(len(key), dtype=np.int32)
        seen[key] = place
        once = seen[key] == place  # a point met twice in a round counts where it was written last
        crow, cand = crow[once], cand[once]
        s = np.einsum("ij,ij->i", x[cand], q[active[crow]])
        better = s > sims[active].min(axis=1)[crow]  # others can't enter their row's list
        crow, cand, s = crow[better], cand[better], s[better]
        count = np.bincount(crow, minlength=len(active))
        if len(crow):  # only the lists that change are sorted anew
            change = np.flatnonzero(count)
            count, mine = count[change], active[change]
            place = np.arange(len(crow)) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(np.arange(len(change)), count)
            new_ids = np.full((len(change), width + int(count.max())), -1, np.int32)
            new_sims = np.full(new_ids.shape, -9.0, np.float32)
            new_fresh = np.zeros(new_ids.shape, dtype=bool)
            new_ids[:, :width], new_sims[:, :width], new_fresh[:, :width] = ids[mine], sims[mine], fresh[mine]
            new_ids[row, width + place], new_sims[row, width + place], new_fresh[row, width + place] = cand, s, True
            top = np.argpartition(-new_sims, width - 1, axis=1)[:, :width]
            flat = np.arange(len(change))[:, None] * new_ids.shape[1] + top
            ids[mine], sims[mine], fresh[mine] = new_ids.ravel()[flat], new_sims.ravel()[flat], new_fresh.ravel()[flat]
        open_ = np.where(fresh[active], sims[active], -99.0)
        alive = open_.max(axis=1) > -90
        active, open_ = active[alive], open_[alive]
        if not len(active):
            break
        k = min(step, width)
        best = np.argpartition(-open_, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (len(active), 1))
        usable = np.take_along_axis(open_, best, 1) > -90
        points = np.where(usable, np.take_along_axis(ids[active], best, 1), -1)
        fresh[active[:, None], best] = False
        out = edges[np.maximum(points, 0)]
        out = np.where(points[:, :, None] >= 0, out, -1).reshape(len(active), -1)
        cols = out.shape[1]
        cand, crow = out.ravel(), np.repeat(np.arange(len(active)), cols)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many points at once: (points, degree) neighbours, -1 where fewer are kept.

    The nearest candidate is kept; candidates that are closer to it (relaxed
    by alpha, in squared distance) than to the point are dropped; and again.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    ok = (cand >= 0) & (cand != own[:, None])
    ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    v = x[np.maximum(cand, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))  # similarities among candidates
    far = 2 - 2 * sims
    out = np.full((len(cand), degree), -1, np.int32)
    rows = np.arange(len(cand))
    kept = np.zeros(len(cand), np.int64)
    for _ in range(degree):
        first = np.argmax(ok, axis=1)
        has = ok[rows, first]
        if not has.any():
            break
        r, f = rows[has], first[has]
        out[r, kept[r]] = cand[r, f]
        kept[r] += 1
        gap = 2 - 2 * between[r, f]
        ok[r] &= alpha * alpha * gap > far[r]
        ok[r, f] = False
    return out


class Graph:
    """The graph of one shard."""

    def __init__(self, x: np.ndarray, degree: int = 20, width: int = 24, alpha: float = 1.2, batch: int = 1024):
        self.x, self.degree, self.width = x, degree, width
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        order = np.random.default_rng(7).permutation(n)
        done = min(n, 128)
        head = order[:done]
        if done > 1:
            s = x[head] @ x[head].T
            np.fill_diagonal(s, -8.0)
            near = np.argpartition(-s, min(width, done - 1) - 1, axis=1)[:, : min(width, done - 1)]
            self.edges[head] = prune(x, head, head[near], np.take_along_axis(s, near, 1), degree, alpha)
        self.pivots = head
        while done < n:
            block = order[done : done + min(batch, done, max(16, 16_000_000 // n))]
            found, sims = beam(x, self.edges, x[block], self.entry(x[block]), width)
            mates, mate_sims = self._mates(block)
            self.edges[block] = prune(x, block, np.concatenate([found, mates], axis=1), np.concatenate([sims, mate_sims], axis=1), degree, alpha)
            self._reverse(block, alpha)
            done += len(block)
            self.pivots = order[: min(done, max(128, int(2 * np.sqrt(n))))]

    def entry(self, q: np.ndarray, count: int = 3) -> np.ndarray:
        """The pivots nearest to each query, where its search starts."""
        s = q @ self.x[self.pivots].T
        count = min(count, len(self.pivots))
        return self.pivots[np.argpartition(-s, count - 1, axis=1)[:, :count]]

    def _mates(self, block: np.ndarray, count: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points of the same batch, which a search over the graph so far can't propose."""
        s = self.x[block] @ self.x[block].T
        np.fill_diagonal(s, -8.0)
        count = min(count, len(block) - 1)
        near = np.argpartition(-s, count - 1, axis=1)[:, :count] if count > 0 else np.zeros((len(block), 0), int)
        return block[near].astype(np.int32), np.take_along_axis(s, near, 1)

    def _reverse(self, block: np.ndarray, alpha: float) -> None:
        """Edges back from the neighbours of new points; full neighbours are pruned again."""
        source = np.repeat(block, self.degree)
        target = self.edges[block].ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        extra = np.full((len(points), int(count.max(initial=0))), -1, np.int32)
        extra[np.repeat(np.arange(len(points)), count), place] = source
        held = (self.edges[points] >= 0).sum(axis=1)
        room = held + count <= self.degree
        for i in np.flatnonzero(room).tolist():
            self.edges[points[i], held[i] : held[i] + count[i]] = extra[i, : count[i]]
        full = np.flatnonzero(~room)
        full = full[np.argsort(count[full], kind="stable")]  # points with about as many new edges go together: little padding
        for a in range(0, len(full), 512):
            some = full[a : a + 512]
            cand = np.concatenate([self.edges[points[some]], extra[some, : count[some[-1]]]], axis=1)
            cand.sort(axis=1)
            sims = np.einsum("ijk,ik->ij", self.x[np.maximum(cand, 0)], self.x[points[some]])
            sims[cand < 0] = -9.0
            self.edges[points[some]] = prune(self.x, points[some], cand, sims, self.degree, alpha)

    def query(self, q: np.ndarray, starts: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        block = max(16, min(block, 16_000_000 // max(len(self.x), 1)))  # what a block has seen takes four bytes a point
        for a in range(0, len(q), block):
            s = self.entry(q[a : a + block])
            if starts is not None:
                s = np.concatenate([starts[a : a + block, None], s], axis=1)
            parts.append(beam(self.x, self.edges, q[a : a + block], s, self.width))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _exact(raw_q: np.ndarray, raw_y: np.ndarray) -> np.ndarray:
    a, b = raw_q.astype(np.float64), raw_y.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """id, v (packed 32-bit floats): the vectors that can be compared."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"]).astype(np.float32)  # null components are NaN here
                ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
                yield pd.DataFrame({"id": b["id"].to_numpy()[ok], "v": [r.tobytes() for r in x[ok]]})

    return rows.mapInPandas(pack, "id bigint, v binary")


def unpacked(v: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float32).reshape(-1, dim)


def copies(vectors: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """id, rep of every vector that stands more than once: its own and its first copy's id.

    Copies are told by two hashes of the values, so only ids and hashes are
    shuffled, and a group however large is never sorted or gathered.
    """
    slim = vectors.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    several = slim.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1").drop("n")
    several = kept(several)
    few = several.count() <= most_broadcast
    return (slim.join(F.broadcast(several), ["h1", "h2"]) if few else split_join(slim, several, ["h1", "h2"], right_hot={})).select("id", "rep")


def _sample(vectors: DataFrame, n: int, most: int, dim: int) -> np.ndarray:
    """At most ``most`` of the ``n`` vectors, by hash; those above the expected share never leave their executors."""
    share = min(1.0, 1.1 * most / n + 50 / n)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    rows = vectors.where(h < int(share * (1 << 40))).select(h.alias("h"), "id", "v").collect()
    return unpacked([r.v for r in sorted(rows, key=lambda r: (r.h, r.id))[:most]], dim)


def near_cells(v: np.ndarray, cells: np.ndarray, limit: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells within ``limit`` of each unit vector: the distance to the border with its nearest cell (or ``home``)."""
    s = v @ cells.T
    mine = np.argmax(s, axis=1) if home is None else home
    apart = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 1e-9))
    margin = (s[np.arange(len(v)), mine][:, None] - s) / apart[mine]
    near = margin <= limit[:, None]
    near[np.arange(len(v)), mine] = True
    return np.nonzero(near)


class Cells:
    """Cells of two levels: centroids of the first, held by every task; those of the second within each large cell.

    The first level has at most ``most_fit / 8`` centroids (a bound of a few MB,
    whatever the number of vectors). A cell above ``most_shard`` is divided by
    centroids fitted to a sample of its own; these are one packed row per large
    cell, which vectors meet by a cogroup, so they never reach the driver.
    """

    def __init__(self, points: DataFrame, n: int, dim: int, most_fit: int, shard: int, most_shard: int):
        spark, self.dim = points.sparkSession, dim
        sample = _sample(points, n, most_fit, dim)
        self.shared = shared = spark.sparkContext.broadcast(fit_centroids(unit(np.unique(sample, axis=0)), max(1, min(-(-n // shard), len(sample) // 8 or 1))))

        @F.pandas_udf("int")
        def home(v: pd.Series) -> pd.Series:
            return pd.Series(np.argmax(unit(unpacked(v, dim)) @ shared.value.T, axis=1).astype(np.int32))

        self.homed = points.withColumn("cell", home("v"))
        sizes = {r[0]: r[1] for r in self.homed.groupBy("cell").count().collect()}  # one row per centroid
        self.large = {cell: m for cell, m in sizes.items() if m > most_shard}
        if not self.large:
            return
        rows = [(cell, -(-m // shard), int(min(1.0, 1.1 * most_fit / m) * (1 << 40)), -(-m // (25 * shard))) for cell, m in sorted(self.large.items())]
        self.plan = F.broadcast(spark.createDataFrame(rows, "cell int, wanted int, below bigint, slices int"))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.unique(unpacked(pdf.sort_values("id")["v"], dim), axis=0))
            c = fit_centroids(x, max(1, min(int(pdf["wanted"].iloc[0]), len(x) // 8)))
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "centroids": [c.tobytes()]})

        some = self.homed.join(self.plan, "cell").where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.col("below")).select("cell", "id", "v", "wanted")
        self.second = cut(some.groupBy("cell").applyInPandas(fit, "cell int, centroids binary"))

    def pieces(self, rows: DataFrame, limited: bool) -> DataFrame:
        """id, v, cell, piece of rows in large cells: the piece of each vector, or all within its ``limit`` if ``limited``."""
        dim = self.dim

        def work(own: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({"id": np.zeros(0, np.int64), "v": [], "cell": np.zeros(0, np.int32), "piece": np.zeros(0, np.int32)})
            c = np.frombuffer(centroids["centroids"].iloc[0], np.float32).reshape(-1, dim)
            v = unit(unpacked(own["v"], dim))
            r, piece = near_cells(v, c, own["limit"].to_numpy()) if limited else (np.arange(len(v)), np.argmax(v @ c.T, axis=1))
            return pd.DataFrame({"id": own["id"].to_numpy()[r], "v": own["v"].to_numpy()[r], "cell": own["cell"].to_numpy()[r], "piece": piece.astype(np.int32)})

        slices = self.plan
        sliced = rows.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), "slices"))
        held = self.second.join(slices, "cell").select("cell", "centroids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1)).alias("slice"))
        cols = ["id", "v", "cell", "slice", *(["limit"] if limited else [])]
        return sliced.select(cols).groupBy("cell", "slice").cogroup(held.groupBy("cell", "slice")).applyInPandas(work, "id bigint, v binary, cell int, piece int")

    def placed(self) -> DataFrame:
        """id, v, cell, piece of every vector."""
        small = self.homed.where(~F.col("cell").isin(sorted(self.large))) if self.large else self.homed
        small = small.withColumn("piece", F.lit(0))
        return small.unionByName(self.pieces(self.homed.where(F.col("cell").isin(sorted(self.large))), False)) if self.large else small

    def guests(self, rows: DataFrame) -> DataFrame:
        """id, v, cell, piece of each vector of ``rows`` (id, v, cell, piece, limit) in the other shards within its ``limit``."""
        shared, large, dim = self.shared, frozenset(self.large), self.dim

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    mine, limit = b["cell"].to_numpy(), b["limit"].to_numpy()
                    r, cell = near_cells(unit(unpacked(b["v"], dim)), shared.value, limit, mine)
                    go = (cell != mine[r]) | np.isin(cell, list(large))
                    r, cell = r[go], cell[go].astype(np.int32)
                    yield pd.DataFrame({"id": b["id"].to_numpy()[r], "v": b["v"].to_numpy()[r], "cell": cell, "limit": limit[r], "home": mine[r], "piece": b["piece"].to_numpy()[r]})

        routed = rows.mapInPandas(route, "id bigint, v binary, cell int, limit double, home int, piece int")
        if not large:
            return routed.select("id", "v", "cell", F.lit(0).alias("piece"))
        inside = F.col("cell").isin(sorted(large))
        own = rows.where(inside).select("id", "cell", "piece")
        return routed.where(~inside).select("id", "v", "cell", F.lit(0).alias("piece")).unionByName(self.pieces(routed.where(inside), True).join(own.hint("merge"), ["id", "cell", "piece"], "left_anti").select("id", "v", "cell", "piece"))


def neighbours(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, least: float = 0.9, most_fit: int = 20_000, shard: int = 4_000, most_shard: int = 8_000, reach: float = 1.5, degree: int = 20, width: int = 24, most_broadcast: int = 1_000_000) -> DataFrame:
    """id, other, cosine: for every vector its k most similar others, as far as their cosine is at least ``least``."""
    vectors = kept(usable(df, key, vector, dim))
    n = vectors.count()
    if n == 0:
        return vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine"))
    again = kept(copies(vectors, most_broadcast))
    later = again.where("id <> rep").select("id")
    later = F.broadcast(later) if later.count() <= most_broadcast else later.hint("merge")
    cells = Cells(vectors.join(later, "id", "left_anti"), n, dim, most_fit, shard, most_shard)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, raw = pdf["id"].to_numpy(), unpacked(pdf["v"], dim)
        graph = Graph(unit(raw), degree, width)
        found, sims = graph.query(graph.x, np.arange(len(ids)))
        r, col = np.nonzero((found >= 0) & (found != np.arange(len(ids))[:, None]) & (sims >= least - 1e-4))
        cosine = _exact(raw[r], raw[found[r, col]])
        ok = cosine >= least
        r, other, cosine = r[ok], ids[found[r, col]][ok], cosine[ok]
        ends = np.searchsorted(r, np.arange(len(ids) + 1))
        kth = np.array([np.partition(cosine[a:b], -k)[-k] if b - a >= k else least for a, b in zip(ends[:-1], ends[1:])])
        return pd.DataFrame({
            "id": ids, "v": pdf["v"], "cell": pdf["cell"], "piece": pdf["piece"], "node": np.arange(len(ids), dtype=np.int32), "edges": [e.tobytes() for e in graph.edges.astype(np.int16 if len(ids) < 32_000 else np.int32)],
            "limit": reach * np.sqrt(np.maximum(2 - 2 * kth, 0)) / np.sqrt(dim), "others": np.split(other, ends[1:-1]), "cosines": np.split(cosine, ends[1:-1]),
        })

    ddl = "id bigint, v binary, cell int, piece int, node int, edges binary, limit double, others array<bigint>, cosines array<double>"
    index = kept(cells.placed().groupBy("cell", "piece").applyInPandas(build, ddl))
    own = index.select("id", F.explode(F.arrays_zip("others", "cosines")).alias("h")).select("id", F.col("h.others").alias("other"), F.col("h.cosines").alias("cosine"))
    guests = cells.guests(index.select("id", "v", "cell", "piece", "limit"))

    def visit(nodes: pd.DataFrame, guests_: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(guests_):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        nodes = nodes.sort_values("node", ignore_index=True)
        ids, raw = nodes["id"].to_numpy(), unpacked(nodes["v"], dim)
        graph = Graph.__new__(Graph)
        packed = np.frombuffer(b"".join(nodes["edges"]), np.int16 if len(ids) < 32_000 else np.int32)
        graph.x, graph.edges, graph.degree, graph.width = unit(raw), packed.reshape(len(ids), degree).astype(np.int32), degree, width
        graph.pivots = np.random.default_rng(7).permutation(len(ids))[: max(128, int(2 * np.sqrt(len(ids))))]
        q = unpacked(guests_["v"], dim)
        found, sims = graph.query(unit(q))
        r, col = np.nonzero((found >= 0) & (sims >= least - 1e-4))
        cosine = _exact(q[r], raw[found[r, col]])
        ok = cosine >= least
        return pd.DataFrame({"id": guests_["id"].to_numpy()[r][ok], "other": ids[found[r, col]][ok], "cosine": cosine[ok]})

    abroad = index.select("cell", "piece", "node", "id", "v", "edges").groupBy("cell", "piece").cogroup(guests.groupBy("cell", "piece")).applyInPandas(visit, "id bigint, other bigint, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    met = cut(own.unionByName(abroad).dropDuplicates(["id", "other"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    if again.isEmpty():
        return met

    # ---- back from distinct vectors to rows: copies are each other's nearest, and come along with their first
    itself = again.where("id = rep").select("id", F.col("id").alias("other"), F.lit(2.0).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))  # limited before the shuffle
    some = again.withColumn("rank", place).where(F.col("rank") <= k + 1).select(F.col("rep").alias("other"), F.col("id").alias("other_row"))
    wide = met.unionByName(itself).join(some, "other", "left").withColumn("other_row", F.coalesce("other_row", "other"))
    rows = again.select(F.col("rep").alias("id"), F.col("id").alias("row"))
    alone = wide.join(rows.select("id").distinct().hint("merge"), "id", "left_anti").withColumn("row", F.col("id"))
    out = split_join(rows, wide, ["id"], right_hot={}).select(alone.columns).unionByName(alone).where("row <> other_row")
    last = Window.partitionBy("row").orderBy(F.desc("cosine"), "other_row")
    out = out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select(F.col("row").alias("id"), F.col("other_row").alias("other"), F.least(F.col("cosine"), F.lit(1.0)).alias("cosine"))
