"""Messages to models as column expressions; absent parts leave no line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicons as X


def _said(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def facts(**parts: Column) -> Column:
    """name=value of the parts that are there; (none) where none is."""
    given = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), v)) for k, v in parts.items()]
    line = F.concat_ws("; ", *given)
    return F.when(line == "", "(none)").otherwise(line)


def justification(person: Column, place: Column, at: Column, is_at: Column, conf_at: Column, conf_is_at: Column, reasoning: Column, date: Column, language: Column, text: Column, about_person: Column, about_place: Column, links: Column) -> Column:
    """The message that asks for a justification of a classification."""
    certain = lambda c: F.when(c.isNull(), "n/a").otherwise(F.format_string("%.2f", c.cast("double")))
    first = lambda c: F.coalesce(c, F.lit(""))
    why = F.when(F.coalesce(reasoning, F.lit("")) == "", "(none provided)").otherwise(reasoning)
    lines = [
        F.lit(X.JUSTIFY_HEADS["relation"]), F.concat(F.lit("Person: '"), first(person), F.lit("'  Location: '"), first(place), F.lit("'")),
        F.concat(F.lit("at = "), _said(at), F.lit(" (confidence: "), certain(conf_at), F.lit(")")), F.concat(F.lit("isAt = "), _said(is_at), F.lit(" (confidence: "), certain(conf_is_at), F.lit(")")),
        F.concat(F.lit("Classifier reasoning: "), why), F.lit(""), F.concat(F.lit("Publication date: "), _said(date)), F.concat(F.lit("Language: "), _said(language)), F.lit(""),
        F.lit(X.JUSTIFY_HEADS["text"]), F.concat(F.lit('"'), first(text), F.lit('"')), F.lit(""), F.lit(X.JUSTIFY_HEADS["knowledge"]),
        F.concat(F.lit("Person: "), about_person), F.concat(F.lit("Location: "), about_place), F.when(F.coalesce(links, F.lit("")) != "", F.concat(F.lit("Known links: "), links)), F.lit(""), F.lit(X.JUSTIFY_TASK),
    ]
    return F.concat_ws("\n", *lines)


def escalation(at: Column, is_at: Column, conf_at: Column, conf_is_at: Column, reasoning: Column, justified: Column, strength: Column, flags: Column, narrative: Column, reason: Column) -> Column:
    """What a stronger model is told of the first pass; ``justified`` says whether there was a justification at all."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    listed = F.concat(F.lit("['"), F.array_join(flags, "', '"), F.lit("']"))
    lines = [
        F.lit(X.ESCALATE_HEADS["first"]), F.concat(F.lit("at="), _said(at), F.lit(", isAt="), _said(is_at)),
        F.when(conf_at.isNotNull() | conf_is_at.isNotNull(), F.concat(F.lit("conf_at="), _said(conf_at), F.lit(", conf_isAt="), _said(conf_is_at))), F.when(has(reasoning), F.concat(F.lit("reasoning: "), reasoning)),
        F.when(justified, ""), F.when(justified, X.ESCALATE_HEADS["findings"]), F.when(justified, F.concat(F.lit("evidence_strength: "), _said(strength))),
        F.when(justified & (F.size(flags) > 0), F.concat(F.lit("flags: "), listed)), F.when(justified & has(narrative), F.concat(F.lit("narrative: "), narrative)),
        F.when(has(reason), ""), F.when(has(reason), X.ESCALATE_HEADS["flags"]), F.when(has(reason), reason), F.lit(""), F.lit(X.ESCALATE_TASK),
    ]
    return F.concat_ws("\n", *lines)
