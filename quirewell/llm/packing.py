"""Filling fixed-capacity containers with items by sum-of-squares packing.

Texts are measured in tokens of a public tokenizer. Only a text above the
capacity is cut: into full containers and one rest. Every other piece stays
whole. Pieces are spread over shards by hash; within a shard each goes where
the sum of the squared counts of open containers per residual gap becomes
smallest (into a container whose gap it fits, or into a new one). Containers
that a shard leaves open are themselves pieces of a second round over
neighbouring shards, so shards cost no space.

Defined results for odd input: null and empty texts have no tokens and no
rows; repeated documents are each packed; ties go to the smallest gap; order
of input doesn't matter (pieces are taken in the order of their hash).
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_vocabulary(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[str, bytes]:
    """(pattern, rank file) of a tokenizer, read where the job is written; the pattern comes with the vocabulary's folder."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        return module.PATTERN, f.read()


@functools.lru_cache(4)
def tokenizer(pattern: str, ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def measured(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_tokens of every row with a non-empty text. The vocabulary (a file of a few MB) is sent along; executors need no folder."""
    files = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(*files.value)
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "n_tokens": [len(t.encode_ordinary(x)) for x in batch["t"]]})

    kind = dict(df.dtypes)[key]
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    return picked.mapInPandas(work, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece (sizes from 1 to capacity), by sum of squares; containers are numbered from 0."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    never = np.iinfo(np.int64).max // 4
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            out[i] = made
            made += 1
            continue
        here = count[s:capacity]  # gaps s .. capacity - 1
        cost = np.where(here > 0, 1 - 2 * here, never)
        cost[1:] += 2 * count[1 : capacity - s] + 1  # the gap that remains, if any
        best = int(np.argmin(cost)) if len(cost) else 0
        if len(cost) and cost[best] <= 2 * count[capacity - s] + 1:
            gap = s + best
            container = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, container = capacity, made
            made += 1
        out[i] = container
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(container)
    return out


def containers(sizes: DataFrame, key: str, capacity: int = 2048, per_shard: int = 50_000, most_waste: float = 0.02) -> DataFrame:
    """key, piece, token_start, token_end, container: every token of every row in a container.

    ``sizes`` holds key and n_tokens. A container is named by the shard that
    made it; one that a second round filled further keeps a single name. The
    sizes are cut from their lineage first: names of containers hang on row ids.
    """
    sizes = cut(sizes.select(key, "n_tokens"))
    full = F.expr(f"n_tokens div {capacity}").cast("int")
    whole = sizes.where(f"n_tokens >= {capacity}").select(F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    whole = whole.select("k", "piece", (F.col("piece") * capacity).cast("bigint").alias("token_start"), ((F.col("piece") + 1) * capacity).cast("bigint").alias("token_end"))
    whole = whole.withColumn("container", F.concat(F.lit("w"), F.monotonically_increasing_id().cast("string")))  # keys may repeat
    rests = sizes.where(f"n_tokens % {capacity} > 0").select(F.col(key).alias("k"), full.alias("piece"), (full * capacity).cast("bigint").alias("token_start"), F.col("n_tokens").alias("token_end"))
    n = rests.count()
    shards = max(1, -(-n // per_shard))
    rests = rests.withColumn("h", F.xxhash64("k", "piece")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    kind = dict(sizes.dtypes)[key]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "k", "piece"], ignore_index=True)
        size = (pdf["token_end"] - pdf["token_start"]).to_numpy()
        pdf["local"] = pack(size, capacity)
        used = pdf.groupby("local")["token_end"].sum() - pdf.groupby("local")["token_start"].sum()
        pdf["used"] = pdf["local"].map(used)
        return pdf[["k", "piece", "token_start", "token_end", "shard", "local", "used"]]

    ddl = f"k {kind}, piece int, token_start bigint, token_end bigint, shard int, local bigint, used bigint"
    placed = cut(rests.groupBy("shard").applyInPandas(fill, ddl)).withColumn("name", F.concat(F.col("shard"), F.lit("."), F.col("local")))
    loose = F.col("used") < capacity * (1 - most_waste)

    def refill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "name"], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({"name": pdf["name"], "again": pack(pdf["used"].to_numpy(), capacity), "team": pdf["team"]})

    left = placed.where(loose).select("name", "used", F.expr("shard div 64").cast("int").alias("team")).distinct()
    again = left.groupBy("team").applyInPandas(refill, "name string, again bigint, team int")
    second = placed.where(loose).join(again, "name").withColumn("container", F.concat(F.lit("t"), F.col("team"), F.lit("."), F.col("again")))
    first = placed.where(~loose).withColumn("container", F.concat(F.lit("s"), F.col("name")))
    cols = ["k", "piece", "token_start", "token_end", "container"]
    return whole.select(cols).unionByName(first.select(cols)).unionByName(second.select(cols)).withColumnRenamed("k", key)
