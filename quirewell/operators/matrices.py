"""Feature matrices as named blocks of columns, and the configurations that combine them.

A block is a dict of name -> column expression over one row per instance, so a
configuration is one projection; only vectors learned elsewhere (spectral
coordinates, principal components) come in by a join on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons as X, text as T
from .ml import SpectralMap

QA_NAMES = [f"qa_{k}_{s}" for k in ("at", "isAt", "evidence") for s in ("score", "has_answer", "span_length", "span_position")] + ["qa_at_isAt_score_gap", "qa_max_score", "qa_evidence_is_dateline"]
CONFIGURATIONS = {"SD-H": (), "SD-HS": ("spectral",), "SD-HSP": ("spectral", "pca"), "SD-HQ": ("qa",), "SD-HQS": ("qa", "spectral")}


def size(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def handcrafted(position: Column, category: Column, distance: Column, status: Column, ocr: Column, language: Column, pers_qid: Column, loc_qid: Column, pers: Column, locs: Column, expressions: Column, signals: Column, text: Column, context: Column, tenses: Column | None = None) -> dict[str, Column]:
    """The 36 named columns: time (15), language (4), person's state (8), counts and lengths (9)."""
    st = F.coalesce(status, F.lit("unknown"))
    known = lambda q: T.flag(F.coalesce(q, F.lit("")) != "")
    length = lambda c, most: F.least(F.lit(1.0), F.length(F.coalesce(c, F.lit(""))) / most)
    return (
        T.temporal_vector(position, category, distance, status, ocr, tenses=tenses)
        | T.one_hot(language, X.LANGUAGES, "lang_") | T.one_hot(st, X.STATUSES, "person_status_")
        | {"has_pers_qid": known(pers_qid), "has_loc_qid": known(loc_qid), "n_pers_mentions": size(pers), "n_loc_mentions": size(locs), "n_temporal_expressions": size(expressions), "n_temporal_signals": size(signals),
           "n_tense_aspect_clusters": size(tenses) if tenses is not None else F.lit(0), "text_len_chars_norm": length(text, 12000.0), "context_len_chars_norm": length(context, 2000.0)}
    )


def evidence(context: Column, text: Column, pers: Column, locs: Column, more: Column) -> dict[str, Column]:
    """The 13 evidence columns; ``more`` are the person's mentions with titles and pronouns."""
    gap, hedges = T.char_gap(context, pers, locs), T.count_hits(context, X.HEDGES)
    count = lambda n, most: F.least(n / most, F.lit(1.0))
    return {
        "entity_char_distance": F.coalesce(F.least(gap / 500.0, F.lit(1.0)), F.lit(1.0)), "entities_adjacent": T.flag(gap < 20), "has_preposition_link": T.flag(T.preposition_link(context, pers, locs)),
        "has_genitive_construction": T.flag(T.genitive(context, locs)), "has_role_title": T.flag(T.contains_any(context, X.ROLES)), "has_hedging": T.flag(hedges > 0), "n_hedging_words": count(hedges, 3.0),
        "has_subjunctive": T.flag(T.contains_any(context, X.SUBJUNCTIVE)), "person_mention_count": count(T.total_count(text, more), 10.0), "location_mention_count": count(T.total_count(text, locs), 10.0),
        "cooccurrence_sentences": count(T.sentences_with_both(text, more, locs), 5.0), "n_competing_locations": count(T.competing_places(text, locs), 10.0), "entity_in_quotes": T.in_quotes(context, pers, locs),
    }


def hierarchy(text: Column, locs: Column, children: Column, parents: Column) -> dict[str, Column]:
    """The 3 columns of a place's hierarchy: its own mentions, those of places inside it, and whether one around it is named."""
    share = lambda n: F.least(F.coalesce(n, F.lit(0)) / 10.0, F.lit(1.0))
    return {"direct_loc_count": share(T.total_count(text, locs)), "hierarchical_loc_count": share(T.total_count(text, children)), "parent_location_mentioned": T.flag(F.exists(parents, lambda p: F.contains(text, p)))}


class Answerer(Protocol):
    def ask(self, question: str, context: str) -> tuple[float, str, int]: ...


class NearestSentence:
    """A stand-in answerer: the first sentence of the context that shares the most capitalised words with the question."""

    def ask(self, question: str, context: str) -> tuple[float, str, int]:
        import re

        names = {w for w in re.findall(r"\w+", question)[1:] if w[:1].isupper()}
        best = (0.0, "", 0)
        for m in re.finditer(r"[^.!?]+[.!?]?", context):
            held = names & set(re.findall(r"\w+", m[0]))
            score = len(held) / max(len(names), 1)
            if score > best[0]:
                best = (score, m[0].strip(), m.start() + len(m[0]) - len(m[0].lstrip()))
        return best


def question_block(df: DataFrame, person: str, place: str, language: str, context: str, text: str, is_dateline: str, answerer: Answerer) -> DataFrame:
    """df with the 15 columns of three questions per row, asked in Arrow batches.

    Rows without person, place or context get zeros (positions too); a failing
    answerer gives zeros and position 0.5. The last column says whether the
    first question's answer lies in the head or tail where a dateline stands.
    """
    ddl = ", ".join(f"{n} double" for n in QA_NAMES[:-1]) + ", span string"

    @F.pandas_udf(ddl)
    def ask(persons: pd.Series, places: pd.Series, languages: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        out = []
        for p, q, lang, c in zip(persons, places, languages, contexts):
            row: dict = dict.fromkeys(QA_NAMES[:-1], 0.0) | {"span": ""}
            for kind, by in X.QUESTIONS.items() if p and q and c else ():
                try:
                    score, answer, start = answerer.ask(by.get((lang or "en").lower(), by["en"]).format(person=p, location=q), c)
                    values = (score, float(score > X.ANSWERED), len(answer) / len(c), start / len(c))
                except Exception:  # noqa: BLE001 - whatever a model raises
                    values, answer = (0.0, 0.0, 0.0, 0.5), ""
                row |= dict(zip((f"qa_{kind}_{s}" for s in ("score", "has_answer", "span_length", "span_position")), map(float, values)))
                if kind == "at":
                    row["span"] = answer
            row["qa_at_isAt_score_gap"], row["qa_max_score"] = row["qa_at_score"] - row["qa_isAt_score"], max(row["qa_at_score"], row["qa_isAt_score"])
            out.append(row)
        return pd.DataFrame(out, columns=[*QA_NAMES[:-1], "span"])

    t = df.withColumn("_qa", ask(F.col(person), F.col(place), F.col(language), F.coalesce(context, text)))
    cross = T.flag((F.col(is_dateline) > 0) & (F.col("_qa.qa_at_has_answer") > 0) & (T.span_near_edge(F.col(text), F.col("_qa.span"), X.EDGE) > 0))
    return t.withColumns({n: F.col(f"_qa.{n}") for n in QA_NAMES[:-1]} | {QA_NAMES[-1]: cross}).drop("_qa")


def padded_block(cache: DataFrame, key: str) -> DataFrame:
    """A cached block of answers with all 15 columns: the last one is zero where an old cache lacks it; any other gap is an error."""
    missing = [n for n in QA_NAMES if n not in cache.columns]
    extra = [c for c in cache.columns if c != key and c not in QA_NAMES]
    if extra or missing not in ([], QA_NAMES[-1:]):
        raise ValueError(f"columns missing: {missing}, unknown: {extra}")
    return cache.withColumns({n: F.lit(0.0) for n in missing}).select(key, *QA_NAMES)


def projected(df: DataFrame, key: str, vector: str, k: int, prefix: str = "MASK_PC") -> DataFrame:
    """key and the first k principal components of the standardised vectors; Spark's transform doesn't centre, so the scaler does."""
    t = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=False).fit(t).transform(t)
    p = PCA(k=k, inputCol="s", outputCol="p").fit(scaled).transform(scaled)
    return p.select(key, *[vector_to_array("p")[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def spectral(df: DataFrame, key: str, vector: str, k: int, near: int = 15, most: int = 4_000) -> DataFrame:
    """key and k eigenmap coordinates, numbered from 2 as the first eigenvector says nothing."""
    t = SpectralMap(components=k, near=near, most=most).fit(df, vector, key).transform(df, key, vector)
    return t.select(key, *[F.get(vector, F.lit(i)).alias(f"spectral_EV{i + 2}") for i in range(k)])


def configured(base: DataFrame, key: str, blocks: dict[str, Callable[[], DataFrame]], configuration: str) -> DataFrame:
    """The matrix of a configuration: ``base`` (key and the columns that are always there) with the learned blocks it asks for."""
    if configuration not in CONFIGURATIONS:
        raise ValueError(f"unknown configuration {configuration!r}; choose one of {tuple(CONFIGURATIONS)}")
    out = base
    for name in CONFIGURATIONS[configuration]:
        if name not in blocks:
            raise ValueError(f"{configuration} needs the block {name!r}")
        out = out.join(blocks[name](), key, "left")
    return out
