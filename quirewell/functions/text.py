"""Text, date and array features over whole texts: column expressions, Arrow batches where patterns depend on the row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import lexicons as X

FLAGS = "(?iuU)"


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains any word, as a substring."""
    low = F.lower(text)
    out = F.lit(False)
    for w in dict.fromkeys(x.lower() for x in words):
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def count_hits(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    terms = [F.coalesce(F.contains(low, F.lit(w)).cast("int"), F.lit(0)) for w in (x.lower() for x in words)]
    return sum(terms[1:], terms[0])


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences, as many as ``str.count`` counts."""
    return F.coalesce(F.try_divide(F.length(text) - F.length(F.replace(text, needle)), F.length(needle)), F.lit(0.0)).cast("bigint")


def known(mentions: Column) -> Column:
    return F.filter(F.coalesce(mentions, F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != ""))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# ---- time


def _tagged_with(category: str):
    return lambda s: F.struct(s.alias("surface"), F.lit(category).alias("category"))


def temporal_signals(text: Column) -> Column:
    """array<struct<surface, category>> of every lexicon match."""
    parts = []
    for category, patterns in (("negation", X.NEGATION), ("present", X.PRESENT), ("relative_only", X.RELATIVE)):
        for p in patterns:
            found = F.regexp_extract_all(text, F.lit(FLAGS + "(" + p + ")"), F.lit(1))
            parts.append(F.transform(found, _tagged_with(category)))
    return F.flatten(F.array(*parts))


def signal_category(text: Column) -> Column:
    """negation before present before relative_only; no_signal without any."""
    hit = lambda ps: text.rlike(FLAGS + "(?:" + "|".join(ps) + ")")
    return F.when(hit(X.NEGATION), "negation").when(hit(X.PRESENT), "present").when(hit(X.RELATIVE), "relative_only").otherwise("no_signal")


def pub_date(date: Column) -> Column:
    """YYYY-MM-DD; months and years start on their first day; anything else is 1900-01-01."""
    s = F.substring(date, 1, 10)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01"))).when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01"))).otherwise("1900-01-01")


def nearest_timex(expressions: Column, date: Column) -> Column:
    """Signed days from the date to the nearest expression's value (first of equals); values under 7 characters don't count."""
    pub = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date))
    full = lambda v: F.when(F.length(v) >= 7, F.try_to_date(F.concat(v, F.when(v.rlike(r"^\d{4}-\d{1,2}$"), F.lit("-01")).otherwise(F.lit("")))))
    deltas = F.filter(F.transform(expressions, lambda t: F.datediff(full(t["value"]), pub)), lambda x: x.isNotNull())
    near = F.array_min(F.transform(deltas, lambda x, i: F.struct(F.abs(x).alias("a"), i.alias("i"), x.alias("d"))))
    return near["d"]


def person_status(birth: Column, death: Column, year: Column, threshold: int = 1980) -> Column:
    """Life status against the year of publication; unknown without either."""
    return F.when(year.isNull(), "unknown").when(birth.isNull() | (birth > year), "no_match").when(death.isNotNull() & (death < year), "dead_historical").when(year < threshold, "alive_past").otherwise("alive_now")


def location_match(person_known: Column, place_known: Column, linked: Column) -> Column:
    return F.when(~person_known | ~place_known, "unknown").when(linked, "match").otherwise("no_match")


def temporal_vector(position: Column, category: Column, distance: Column, status: Column, ocr: Column, window: int = 30, tenses: Column | None = None) -> dict[str, Column]:
    """15 named features. ``tenses``: array<struct<tense, negated>>, if a tagger supplied one."""
    sp = F.coalesce(position, F.lit(-1))
    cat = F.coalesce(category, F.lit("no_signal"))
    st = F.coalesce(status, F.lit("unknown"))
    verb = lambda start: flag(F.exists(tenses, lambda c: F.lower(c["tense"]).startswith(start))) if tenses is not None else F.lit(0.0)
    return {
        "verb_is_present": verb("pres"), "verb_is_past": verb("past"), "verb_is_negated": flag(F.exists(tenses, lambda c: c["negated"])) if tenses is not None else F.lit(0.0), "verb_is_future": verb("fut"),
        "sentence_position_norm": F.when(sp >= 0, clip(sp / 50.0)).otherwise(0.0), "is_lead_paragraph": flag(sp.between(0, 1)),
        "signal_negation": flag(cat == "negation"), "signal_present": flag(cat == "present"), "signal_relative": flag(cat == "relative_only"), "signal_none": flag(cat.isin("no_signal", "")),
        "has_timex_in_window": flag(F.abs(distance) <= window), "nearest_timex_distance_norm": F.coalesce(clip(F.abs(distance) / 365.0), F.lit(0.0)),
        "person_is_deceased": flag(st == "dead_historical"), "person_status_known": flag(~st.isin("unknown", "no_match")), "ocr_quality": F.coalesce(ocr, F.lit(1.0)),
    }


def one_hot(value: Column, names: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}": flag(value == n) for n in names}


# ---- entities in context


def _position(text: Column, m: Column) -> Column:
    return F.instr(text, m)


def char_gap(context: Column, pers: Column, locs: Column) -> Column:
    """The smallest gap between the first occurrences of a person and a place mention; null if no pair occurs."""
    def pair(p):
        def one(q):
            a, b = _position(context, p), _position(context, q)
            gap = F.greatest(F.lit(0), F.abs(a - b) - F.when(a < b, F.length(p)).otherwise(F.length(q)))
            return F.when((a > 0) & (b > 0), gap)

        return F.array_min(F.transform(locs, one))

    return F.array_min(F.transform(pers, pair))


def _quoted(m: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(m, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def any_pair(a: Column, b: Column, test) -> Column:
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: test(x, y))), F.lit(False))


def preposition_link(context: Column, pers: Column, locs: Column) -> Column:
    """A person and a place joined by a preposition, in either order; patterns run only where both occur."""
    def test(p, q):
        both = F.contains(F.lower(context), F.lower(p)) & F.contains(F.lower(context), F.lower(q))
        pattern = lambda x, y: F.concat(F.lit(FLAGS), _quoted(x), F.lit(r"\s*,?\s*" + X.PREPOSITION), _quoted(y))
        return both & (F.regexp(context, pattern(p, q)) | F.regexp(context, pattern(q, p)))

    return any_pair(pers, locs, test)


def genitive(context: Column, locs: Column) -> Column:
    return F.coalesce(F.exists(locs, lambda q: F.contains(F.lower(context), F.lower(q)) & F.regexp(context, F.concat(F.lit(FLAGS + "(?:" + "|".join(X.GENITIVE) + ")"), _quoted(q)))), F.lit(False))


def total_count(text: Column, mentions: Column) -> Column:
    return F.aggregate(mentions, F.lit(0).cast("bigint"), lambda a, m: a + occurrences(text, m))


def sentences_with_both(text: Column, pers: Column, locs: Column) -> Column:
    has = lambda s, ms: F.exists(ms, lambda m: F.contains(s, m))
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: has(s, pers) & has(s, locs)))


def competing_places(text: Column, locs: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(" + X.PLACE.replace(r"\b", "(?U)\\b", 1) + ")"), F.lit(1)))
    return F.greatest(F.lit(0), F.size(found) - F.size(locs))


def expanded(context: Column, pers: Column, language: Column) -> Column:
    """Person mentions with titles near them and the pronouns of their sentences."""
    def by_language(make):
        out = make("en")
        for lang in ("fr", "de", "lb"):
            out = F.when(language == lang, make(lang)).otherwise(out)
        return out

    def titles(lang):
        pattern = X.TITLES[lang] if lang != "lb" else f"(?:{X.TITLES['lb']}|{X.TITLES['de']})"

        def near(m):
            at = F.instr(context, m)
            left = F.greatest(F.lit(1), at - 80)
            around = F.concat(context.substr(left, at - left), F.lit(" "), context.substr(at + F.length(m), F.lit(80)))
            return F.when(at > 0, F.regexp_extract_all(around, F.lit(FLAGS + "(" + pattern + ")"), F.lit(1))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(pers, near))

    def pronouns(lang):
        words = X.PRONOUNS[lang] + (X.PRONOUNS["de"] if lang == "lb" else [])
        named = F.filter(F.split(context, r"[.!?]+"), lambda s: F.exists(pers, lambda m: F.contains(s, m)))
        says = lambda w: F.exists(named, lambda s: s.rlike(FLAGS + r"\b" + w + r"\b"))
        return F.array_compact(F.array(*[F.when(says(w), F.lit(w)) for w in dict.fromkeys(words)]))

    return F.array_union(F.array_union(pers, by_language(titles)), by_language(pronouns))


def verb_types(context: Column, language: Column) -> dict[str, Column]:
    """One flag per verb type, and the two derived ones; unknown languages use English verbs."""
    lang = F.lower(F.coalesce(language, F.lit("en")))
    out = {}
    for kind, by in X.VERBS.items():
        value = flag(contains_any(context, by["en"]))
        for name in ("fr", "de", "lb"):
            words = by[name] + (by["de"] if name == "lb" else [])
            value = F.when(lang == name, flag(contains_any(context, words))).otherwise(value)
        out[f"verb_type_{kind}"] = value
    out["verb_strong_evidence"] = F.greatest(out["verb_type_role"], out["verb_type_stative"])
    out["verb_indirect_evidence"] = out["verb_type_communication"]
    return out


def _dateline_patterns() -> dict[str, re.Pattern]:
    """What stands right of a place in each pattern of the lexicon; what stands left of it is white space, told by ``_left``."""
    right = lambda p: re.compile(p.split("{}", 1)[1] if "{}" in p else p, re.IGNORECASE | re.MULTILINE)
    names = ("open_date", "open_stop", "close", "close_line", "end", "mid_date", "mid_stop", "mid_line")
    return dict(zip(names, map(right, [*X.OPENING_DATELINES, *X.CLOSING_DATELINES, *X.MIDDLE_DATELINES]))) | {"date": re.compile(X.CLOSING_DATELINES[2].split("{}")[0] + r"\Z", re.IGNORECASE)}


def dateline_hits(text: str, place: str, patterns: dict[str, re.Pattern]) -> tuple[bool, bool, bool]:
    """Whether a place stands as an opening, closing or middle dateline anywhere in a text.

    Each occurrence is tested by what stands beside it: constant patterns, and
    a search for a date only in the stretch before a comma or full stop.
    """
    opening = closing = middle = False
    for m in re.finditer(re.escape(place), text, re.IGNORECASE):
        i, j = m.span()
        k = len(text[:i].rstrip())
        gap, r = text[k:i], lambda name: patterns[name].match(text, j)  # noqa: B023
        begins, lined = k == 0 or "\n" in gap, "\n" in gap
        stopped = bool(gap) and text[k - 1 : k] == "."
        opening = opening or begins and bool(r("open_date") or r("open_stop"))
        closing = closing or bool(r("close") or lined and r("close_line"))
        if not closing and text[k - 1 : k] in (",", ".") and k and r("end"):
            closing = bool(patterns["date"].search(text[max(0, k - 200) : i]))
        middle = middle or (lined or stopped) and bool(r("mid_date") or r("mid_stop")) or "\n" in text[max(k, 1) : i] and bool(r("mid_line"))
    return opening, closing, middle


def datelines(df: DataFrame, text: str, locs: str, region: int = 100) -> DataFrame:
    """df with the five dateline features: Arrow batches, as patterns that depend on each mention are slow in the JVM."""

    @F.pandas_udf("opening boolean, closing boolean, middle boolean, prose boolean")
    def tests(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        patterns = _dateline_patterns()
        out, low, last = [], "", None
        for t, ps in zip(texts, places):
            if t is None or ps is None:
                out.append((False, False, False, False))
                continue
            if t != last:  # the pairs of one article stand together
                low, last, known = t.lower(), t, {}
            for p in ps:
                if p and p not in known:
                    known[p] = dateline_hits(t, p, patterns) if p.lower() in low else (False, False, False)
            prose = t[region : len(t) - region] if len(t) > 2 * region else ""
            hits = [known[p] for p in ps if p]
            out.append((*(any(h[i] for h in hits) for i in range(3)), bool(prose) and any(p is not None and p in prose for p in ps)))
        return pd.DataFrame(out, columns=["opening", "closing", "middle", "prose"])

    o, c, m, p = (F.col(f"_tests.{x}") for x in ("opening", "closing", "middle", "prose"))
    out = {"location_is_dateline": flag(o | c | m), "location_is_opening_dateline": flag(o), "location_is_closing_dateline": flag(c), "location_is_mid_dateline": flag(m), "location_dateline_only": flag((o | c | m) & ~p)}
    return df.withColumn("_tests", tests(F.col(text), F.col(locs))).withColumns(out).drop("_tests")


def in_quotes(context: Column, pers: Column, locs: Column) -> Column:
    """1.0 if an entity's first occurrence lies in a quoted span: match offsets, so Arrow batches."""

    @F.pandas_udf("double")
    def work(texts: pd.Series, persons: pd.Series, places: pd.Series) -> pd.Series:
        pattern = re.compile(X.QUOTED, re.DOTALL)
        out = []
        for c, p, q in zip(texts, persons, places):
            spans = [m.span() for m in pattern.finditer(c)] if c else []
            at = [c.find(m) for x in (p, q) if x is not None for m in x] if spans else []
            out.append(float(any(a <= i <= z for i in at if i >= 0 for a, z in spans)))
        return pd.Series(out, dtype="float64")

    return work(context, pers, locs)


def span_near_edge(text: Column, span: Column, region: int = 100) -> Column:
    """1.0 if a span's first occurrence starts in the first or last ``region`` characters."""
    at = F.instr(text, span) - 1
    return flag((span != "") & (at >= 0) & ((at < region) | (at > F.length(text) - region)))


# ---- markers, templates, sentences


def wrapped(text: Column, mentions: Column, start: str, end: str) -> tuple[Column, Column]:
    """(text with the earliest mention wrapped, whether one was found); case-insensitive, longest first at equal places."""
    low = F.lower(text)
    hits = F.filter(F.transform(mentions, lambda m: F.struct(F.instr(low, F.lower(m)).alias("at"), (-F.length(m)).alias("short"))), lambda h: h["at"] > 0)
    best = F.array_min(hits)
    at, length = best["at"], -best["short"]
    out = F.concat(text.substr(F.lit(1), at - 1), F.lit(start + " "), text.substr(at, length), F.lit(" " + end), text.substr(at + length, F.lit(2**31 - 1)))
    return F.when(at.isNotNull(), out).otherwise(text), at.isNotNull()


def marked(text: Column, pers: Column, locs: Column, joint: bool = False) -> Column:
    """Both entities marked; those not found stand before the text, each on its own or (joint) together."""
    base = F.coalesce(text, F.lit(""))
    a, found_p = wrapped(base, pers, "[E1]", "[/E1]")
    b, found_l = wrapped(a, locs, "[E2]", "[/E2]")
    p = F.when(~found_p & (F.size(pers) > 0), F.concat(F.lit("[E1] "), F.get(pers, F.lit(0)), F.lit(" [/E1]")))
    q = F.when(~found_l & (F.size(locs) > 0), F.concat(F.lit("[E2] "), F.get(locs, F.lit(0)), F.lit(" [/E2]")))
    if joint:
        prefix = F.concat_ws(" ", p, q)
        return F.when(prefix != "", F.concat(prefix, F.lit(" . "), b)).otherwise(b)
    with_p = F.when(p.isNotNull(), F.concat(p, F.lit(" . "), b)).otherwise(b)
    return F.when(q.isNotNull(), F.concat(q, F.lit(" . "), with_p)).otherwise(with_p)


def tagged(text: Column, mentions: Column, start: str, end: str) -> Column:
    """The earliest mention between tags; white space inside a mention matches any white space."""
    pattern = lambda m: F.concat(F.lit(FLAGS), F.array_join(F.transform(F.filter(F.split(m, r"\s+"), lambda t: t != ""), _quoted), r"\s+"))
    hits = F.transform(F.filter(mentions, lambda m: F.trim(m) != ""), lambda m: F.struct(F.regexp_instr(text, pattern(m)).alias("at"), (-F.length(m)).alias("short"), F.regexp_substr(text, pattern(m)).alias("s")))
    best = F.array_min(F.filter(hits, lambda h: h["at"] > 0))
    at, s = best["at"], best["s"]
    out = F.concat(text.substr(F.lit(1), at - 1), F.lit(start), s, F.lit(end), text.substr(at + F.length(s), F.lit(2**31 - 1)))
    return F.when(at.isNotNull(), out).otherwise(text)


def template(name: str, context: Column, pers: Column, locs: Column, date: Column, mask: str = "[MASK]") -> Column:
    """The cloze templates M1 to M5."""
    first = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    m, when = marked(context, pers, locs), F.when(F.coalesce(date, F.lit("")) == "", "unknown").otherwise(date)
    if name == "M1":
        return F.concat(F.lit("[E1] "), first(pers), F.lit(f" [/E1] {mask} [E2] "), first(locs), F.lit(" [/E2] ."))
    if name == "M2":
        return F.concat(m, F.lit(f" The relationship between [E1] and [E2] is {mask} ."))
    if name == "M3":
        return F.concat(F.lit("Published: "), when, F.lit(" . "), m, F.lit(f" At this time, [E1] is {mask} [E2] ."))
    if name == "M4":
        return F.concat(m, F.lit(f" In general, [E1] is {mask} associated with [E2] . Around "), when, F.lit(f", [E1] is {mask} present at [E2] ."))
    if name == "M5":
        return F.concat(m, F.lit(f" [E1] {mask} {mask} {mask} [E2] ."))
    raise ValueError(f"unknown template {name}")


def sentence_list(text: Column) -> Column:
    """Sentences by final mark and following space (a plain rule; the tagger-free fallback)."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def shared_sentence(text: Column, pers: Column, locs: Column) -> Column:
    """Index of the first sentence that mentions both, -1 if none does."""
    has = lambda s, ms: F.exists(ms, lambda m: F.contains(F.lower(s), F.lower(m)))
    hits = F.filter(F.transform(sentence_list(text), lambda s, i: F.when(has(s, pers) & has(s, locs), i)), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def context_window(text: Column, pers: Column, locs: Column, around: int = 1) -> Column:
    """The sentences around the first shared one; the whole text if there is none."""
    s, i = sentence_list(text), shared_sentence(text, pers, locs)
    lo = F.greatest(F.lit(0), i - around)
    return F.when(i < 0, text).otherwise(F.array_join(F.slice(s, lo + 1, i + around - lo + 1), " "))
