"""External models behind interfaces, with deterministic offline stand-ins.

Nothing here claims the quality of a real model: the stand-ins exist so that
pipelines run end to end without a network. A client answers one prompt at a
time; calls run inside ``mapInPandas``, partition by partition, with retries
and a fallback, and never on the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as P, prompts as M
from ..session import kept
from . import metrics, rules as R
from .labels import AT, IS_AT


class Client(Protocol):
    def chat(self, prompt: str) -> str: ...


class HashClient:
    """Answers by the prompt's hash, in the strict format."""

    def __init__(self, salt: str = ""):
        self.salt = salt

    def chat(self, prompt: str) -> str:
        h = blake2b((self.salt + prompt).encode(), digest_size=4).digest()
        at = ("FALSE", "FALSE", "TRUE", "PROBABLE")[h[0] % 4]
        is_at = "TRUE" if at == "TRUE" and h[1] % 3 == 0 else "FALSE"
        return f"at={at} isAt={is_at} | conf_at={0.5 + h[2] % 50 / 100:.2f} conf_isAt={0.5 + h[3] % 50 / 100:.2f}"


def asked(client: Client, prompt: str, attempts: int = 3, backoff: float = 2.0, fallback: Client | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer after at most ``attempts`` tries with growing pauses, then the fallback's; '' if all fail."""
    for i in range(attempts):
        try:
            return client.chat(prompt)
        except Exception:  # noqa: BLE001 - whatever a transport raises
            if i + 1 < attempts:
                sleep(backoff**i)
    return asked(fallback, prompt, attempts, backoff, None, sleep) if fallback else ""


def answered(df: DataFrame, prompt: str, client: Client, out: str = "raw_output", samples: int = 1, fallback: Client | None = None) -> DataFrame:
    """df with ``samples`` rows per prompt, each with its answer and its latency in ms."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", sample int, `{out}` string, latency_ms double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(samples):
                began = [time.perf_counter()]
                answers = []
                for p in b[prompt]:
                    answers.append(asked(client, p if samples == 1 else f"{p}\n#{i}", fallback=fallback))
                    began.append(time.perf_counter())
                yield b.assign(sample=i, **{out: answers, "latency_ms": [(y - x) * 1000 for x, y in zip(began, began[1:])]})

    return df.mapInPandas(work, schema)


def consistent(df: DataFrame, keys: list[str], raw: str = "raw_output") -> DataFrame:
    """keys, at, isAt, agreement: the majority over samples; ties go to the first seen."""
    t = df.withColumn("p", P.combined(F.col(raw)))
    out = None
    for target in ("at", "isAt"):
        c = t.groupBy(*keys, F.col(f"p.{target}").alias("label")).agg(F.count("*").alias("n"), F.min("sample").alias("first"))
        best = c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "label")).alias("b"), F.sum("n").alias("total"))
        one = best.select(*keys, F.col("b.label").alias(target), (-F.col("b.m") / F.col("total")).alias(f"{target}_agreement"))
        out = one if out is None else out.join(one, keys)
    return out


def agentic(df: DataFrame, keys: list[str], prompt: str, classifier: Client, justifier: Client, stronger: Client) -> DataFrame:
    """Classify, justify, validate; what is flagged is classified again by a stronger model and then accepted as it is.

    The justifier gets a message about the classification, the stronger model
    the first message with what was found and flagged; ``df`` may hold person,
    place, date, language and text for them. Stages are DataFrames: the
    escalated subset is a filter, the result a union.
    """
    given = lambda t, c: F.col(c) if c in t.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    first = answered(df, prompt, classifier, "answer").withColumns({"c": P.combined(F.col("answer")), "why": P.reasoning(F.col("answer"))}).drop("sample", "latency_ms", "answer")

    def judged(t: DataFrame) -> DataFrame:
        message = M.justification(given(t, "person"), given(t, "place"), F.col("c.at"), F.col("c.isAt"), F.col("c.conf_at"), F.col("c.conf_isAt"), F.col("why"), given(t, "date"), given(t, "language"), F.coalesce(given(t, "text"), F.col(prompt)), M.facts(), M.facts(), none)
        j = answered(t.withColumn("ask", message), "ask", justifier, "just").withColumn("j", P.parsed_justification(F.col("just"))).drop("sample", "latency_ms", "just", "ask")
        v = R.checks(F.col("c.at"), F.col("c.isAt"), F.col("c.conf_at"), F.col("c.conf_isAt"), F.coalesce("why", F.lit("")), F.col("j.strength"), F.col("j.flags"), F.col("j.supports"), F.col("j.within_window"))
        return j.withColumn("v", v)

    once = judged(first)
    calm = once.where(~F.col("v.escalate")).withColumn("escalated", F.lit(False))
    more = M.escalation(F.col("c.at"), F.col("c.isAt"), F.col("c.conf_at"), F.col("c.conf_isAt"), F.col("why"), F.col("j.status") != "fail", F.col("j.strength"), F.col("j.flags"), F.col("j.narrative"), F.col("v.reason"))
    told = once.where("v.escalate").withColumn("ask", F.concat_ws("\n\n", prompt, more)).drop("c", "j", "v", "why")
    again = answered(told, "ask", stronger, "answer").withColumns({"c": P.combined(F.col("answer")), "why": P.reasoning(F.col("answer"))}).drop("sample", "latency_ms", "answer", "ask")
    both = calm.unionByName(judged(again).withColumn("escalated", F.lit(True)))
    return both.select(*keys, F.coalesce("c.at", F.lit("FALSE")).alias("at"), F.when(F.coalesce("c.at", F.lit("FALSE")) == "FALSE", "FALSE").otherwise(F.coalesce("c.isAt", F.lit("FALSE"))).alias("isAt"), "escalated", F.col("v.hard").alias("hard"), F.col("v.soft").alias("soft"))


def experiment(df: DataFrame, name: str, predict: Callable[[DataFrame], DataFrame], gold: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, report) of a run: ``predict`` maps instances to at_predicted, isAt_predicted and latency_ms.

    The report holds, per target, rows and macro recall, and the run's mean
    latency; a prediction that is missing counts as FALSE. The run is computed
    once and kept, so a client is never asked twice.
    """
    done = kept(predict(df).withColumn("experiment", F.lit(name)))
    rows = None
    for target, column in gold.items():
        labels = AT if target == "at" else IS_AT
        t = done.withColumn("_p", F.coalesce(f"{target}_predicted", F.lit("FALSE"))).withColumn("target", F.lit(target))
        one = metrics.macro_recall(t, column, "_p", labels, ["experiment", "target"])
        rows = one if rows is None else rows.unionByName(one)
    cost = done.groupBy("experiment").agg(F.avg("latency_ms").alias("latency_ms"))
    return done, rows.join(cost, "experiment")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row: what a lambda names otherwise is computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hashed_embedding(df: DataFrame, text: str, dim: int = 64, out: str = "embedding") -> DataFrame:
    """A stand-in encoder: normalised hashed word counts, all in the JVM.

    Each text is split and hashed once. Nulls and texts without a word give zeros.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))

    def counts(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(s) - F.size(F.array_remove(s, i))).cast("double"))

    def unit(c: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
        return _once(norm, lambda n: F.transform(c, lambda x: (x / n).cast("float")))

    return df.withColumn(out, _once(slots, lambda s: _once(counts(s), unit)))


def no_tags(df: DataFrame) -> DataFrame:
    """A stand-in tagger: no verb clusters, as where no language model is installed."""
    return df.withColumn("tense_aspect", F.array().cast("array<struct<verb_cluster:string,tense:string,aspect:string,mood:string,negated:boolean>>"))


def iso_timexes(df: DataFrame, text: str) -> DataFrame:
    """A stand-in time tagger: ISO dates and years that stand in the text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:1[5-9]|20)\d{2}(?:-\d{2}(?:-\d{2})?)?)\b"), F.lit(1))
    return df.withColumn("temporal_expressions", F.transform(found, lambda s: F.struct(s.alias("surface"), s.alias("value"), F.lit("DATE").alias("type"))))
