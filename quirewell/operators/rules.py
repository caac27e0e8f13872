"""Consistency checks of a classification against its justification, as one struct expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import lexicons as X
from ..functions.text import contains_any


def checks(at: Column, is_at: Column, conf_at: Column, conf_is_at: Column, reasoning: Column, strength: Column, flags: Column, supports: Column, within: Column, hard_only: bool = False, least_at: float = 0.7, least_is_at: float = 0.6, soft_limit: int = 2, escalation: bool = True) -> Column:
    """struct<passed, failed, hard, soft, escalate, reason>. ``within`` is 'true', 'false', 'uncertain' or null."""
    no = lambda c: F.coalesce(c, F.lit(False))
    upper_at, upper_is = F.upper(at), F.upper(is_at)
    no_anchor = no(F.exists(flags, lambda f: F.contains(F.lower(f), F.lit("temporal anchor"))))
    number = lambda v, t: F.concat(v, F.lit(" < "), F.lit(f"{t:.2f}"))
    rules = [
        ("cross_label_coherence", no((upper_is == "TRUE") & (upper_at == "FALSE")), "hard", F.lit("isAt=TRUE with at=FALSE is logically impossible")),
        ("evidence_alignment", no(strength == "contradictory"), "hard", F.lit("justification.evidence_strength=contradictory")),
        ("internal_consistency", no((upper_at == "FALSE") & contains_any(reasoning, X.ASSOCIATION)), "soft", F.lit("classifier reasoning mentions association cue but at=FALSE")),
    ]
    if not hard_only:
        rules += [
            ("temporal_logic", no((upper_is == "TRUE") & (no_anchor | no(within == "false"))), "soft", F.lit("isAt=TRUE but justification finds no temporal anchor within ~1 month")),
            ("wikidata_alignment", no(~supports), "soft", F.lit("Wikidata corroboration says label is unsupported")),
            ("confidence_at", no(conf_at < least_at), "soft", F.concat(F.lit("at confidence "), number(F.format_number(conf_at, 2), least_at))),
            ("confidence_isAt", no(conf_is_at < least_is_at), "soft", F.concat(F.lit("isAt confidence "), number(F.format_number(conf_is_at, 2), least_is_at))),
        ]
    pick = lambda kind: F.array_compact(F.array(*[F.when(bad, text) for _, bad, k, text in rules if k == kind]))
    hard = pick("hard")
    soft = F.array().cast("array<string>") if hard_only else F.array_compact(F.concat(pick("soft"), F.array(F.when(no(strength == "weak"), F.lit("justification.evidence_strength=weak")))))
    escalate = (F.size(hard) > 0) | (F.lit(not hard_only) & (F.size(soft) >= soft_limit)) if escalation else F.lit(False)
    reason = F.when(~escalate, "").when(F.size(hard) > 0, F.get(hard, F.lit(0))).otherwise(F.concat(F.lit("soft: "), F.array_join(soft, "; ")))
    return F.struct(
        F.array_compact(F.array(*[F.when(~bad, F.lit(n)) for n, bad, _, _ in rules])).alias("passed"),
        F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad, _, _ in rules])).alias("failed"),
        hard.alias("hard"), soft.alias("soft"), escalate.alias("escalate"), reason.alias("reason"),
    )


def classify_by_score(at_score: Column, is_at_score: Column, sure: float = 0.3, likely: float = 0.1) -> tuple[Column, Column]:
    at = F.when(at_score >= sure, "TRUE").when(at_score >= likely, "PROBABLE").otherwise("FALSE")
    return at, F.when(is_at_score >= sure, "TRUE").otherwise("FALSE")
