"""Folding of characters that look alike into one, as tables over code points.

The table is built by rule from the Unicode data that Python ships
(compatibility forms that keep a character's look: full and half width,
ligatures, no-break, font and presentation variants) and from a short list of
letters of other scripts that are drawn like Latin ones. Format characters are
ignorable; every single space is an ordinary space. Superscripts, circled
forms and fractions stay: they are visibly different.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Letters of the Cyrillic, Greek and Armenian scripts drawn like Latin letters, and those letters.
LOOKALIKE_FROM = "аеіоѕԁһсрухјӏԛԝАВЕКМНОРСТХЅІЈӀҮԌԚԜοναρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹͿօսոհ"
LOOKALIKE_TO = "aeiosdhcpyxjlqwABEKMHOPCTXSIJIYGQWovapABEZHIKMNOPTYXcjCJounh"
#: Punctuation drawn alike.
PUNCTUATION_FROM = "‐‑⁄∕"
PUNCTUATION_TO = "--//"

KEPT_FORMS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
RANGES = ((0x80, 0x3400), (0xA640, 0xAB70), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20))
N = 0x110000
IGNORED = 0


def _one(ch: str, letters: dict[str, str]) -> str:
    """What one character folds to."""
    if unicodedata.category(ch) in ("Cf", "Cn") or 0xFE00 <= ord(ch) <= 0xFE0F or ch in "͏ᅟᅠㅤﾠ":
        return "" if unicodedata.category(ch) != "Cn" else ch
    if unicodedata.category(ch) == "Zs":
        return " "
    parts = unicodedata.decomposition(ch)
    if parts.startswith("<"):
        form, *codes = parts.split()
        if form not in KEPT_FORMS:
            return ch
        return "".join(_one(chr(int(c, 16)), letters) for c in codes)
    return unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in unicodedata.normalize("NFD", ch)))


@functools.cache
def tables() -> tuple[np.ndarray, dict[int, str]]:
    """(fold of each code point, 0 for an ignorable one; folds that are longer than one character)."""
    letters = dict(zip(LOOKALIKE_FROM + PUNCTUATION_FROM, LOOKALIKE_TO + PUNCTUATION_TO))
    fold, longer = np.arange(N, dtype=np.uint32), {}
    for a, b in RANGES:
        for o in range(a, b):
            if (to := _one(chr(o), letters)) != chr(o):
                if len(to) > 1:
                    longer[o] = to
                else:
                    fold[o] = ord(to) if to else IGNORED
    for o, to in list(longer.items()):
        longer[o] = unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in unicodedata.normalize("NFD", to)))
    return fold, longer


@functools.cache
def _slow() -> np.ndarray:
    """Which code points need the path by strings: combining marks and folds of more than one character."""
    out = np.zeros(N, dtype=bool)
    out[list(tables()[1])] = True
    for a, b in ((0x300, 0x370), (0x483, 0x488), (0x900, 0xE00), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0x302A, 0x3030), (0x3099, 0x309B)):
        out[a:b] |= [unicodedata.combining(chr(o)) > 0 and unicodedata.combining(chr(o)) != 9 for o in range(a, b)]
    out[0x591:0x5C8] = out[0x610:0x620] = out[0x64B:0x660] = True
    out[0x900:0xE00] |= [unicodedata.normalize("NFC", chr(o)) != chr(o) for o in range(0x900, 0xE00)]
    return out


@functools.cache
def _translation() -> dict[int, str | None]:
    fold, longer = tables()
    changed = np.flatnonzero(fold != np.arange(N, dtype=np.uint32))
    return {int(o): (chr(fold[o]) if fold[o] != IGNORED else None) for o in changed} | longer


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def from_codes(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def needs_strings(text: str) -> bool:
    """True where folding has to compose marks or lengthen the text."""
    return not text.isascii() and bool(_slow()[codes(text)].any())


def _by_strings(text: str) -> str:
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text)).translate(_translation())
    return unicodedata.normalize("NFC", folded)


def skeletons(texts: list[str]) -> list[str]:
    """The forms in which texts that look alike are equal."""
    out = list(texts)
    todo = [i for i, x in enumerate(texts) if not x.isascii()]
    if not todo:
        return out
    fold, _ = tables()
    points = codes("".join(texts[i] for i in todo))
    ends = np.cumsum([len(texts[i]) for i in todo])
    starts = ends - [len(texts[i]) for i in todo]
    folded = fold[points]
    changed = np.add.reduceat((folded != points).astype(np.int32), starts)
    slow = np.add.reduceat(_slow()[points].astype(np.int32), starts)
    for i, a, b, c, s in zip(todo, starts, ends, changed, slow):
        if s:
            out[i] = _by_strings(texts[i])
        elif c:
            piece = folded[a:b]
            out[i] = from_codes(piece[piece != IGNORED])
    return out


def skeleton(text: str) -> str:
    """The form of one text."""
    return skeletons([text])[0]


@functools.cache
def caseless() -> np.ndarray:
    """Fold of each code point for searches that also ignore case, accents and punctuation.

    Letters and digits map to one representative of everything that equals
    them by case or look, transitively; white space maps to 0, and all else
    (punctuation, ignorable characters, accents) to N, to be dropped.
    """
    fold, _ = tables()
    out = np.full(N, N, dtype=np.uint32)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    small = [o for a, b in ((0, 0x3400), (0xA640, 0xAB70), (0xFF00, 0x10000), (0x10400, 0x10450), (0x1D400, 0x1D800)) for o in range(a, b)]
    for o in small:
        ch = chr(o)
        cat = unicodedata.category(ch)
        if ch.isspace():
            out[o] = 0
        elif cat[0] in "LN" or cat[0] == "M" and 0x900 <= o < 0xE80:
            out[o] = o
    out[0x3400:0xA000] = np.arange(0x3400, 0xA000)
    out[0xA000:0xA640] = np.arange(0xA000, 0xA640)
    out[0xAB70:0xD7B0] = np.arange(0xAB70, 0xD7B0)
    out[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    for a, b in ((0x2E80, 0x2FE0), (0xF900, 0xFB00), (0x2F800, 0x2FA20)):
        out[a:b] = fold[a:b]
    for o in small:
        if out[o] in (0, N):
            continue
        ch = chr(o)
        base = unicodedata.normalize("NFD", ch)[0] if not 0x900 <= o < 0xE80 else ch
        for other in {chr(fold[o]) if fold[o] else ch, ch.lower(), ch.upper(), base}:
            if len(other) == 1 and (a := find(o)) != (b := find(ord(other))):
                parent[max(a, b)] = min(a, b)
    for o in small:
        if out[o] not in (0, N):
            out[o] = find(o)
    return out


def searchable(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts, joined, as (caseless fold, index of the text, position in it); dropped characters are left out.

    Before every text and after the last stands a 0 that belongs to no text (index -1).
    """
    table = caseless()
    _, longer = tables()
    flags = np.zeros(N, dtype=bool)
    flags[list(longer)] = True
    joined = codes("".join(texts))
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    number = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if (wide := np.flatnonzero(flags[joined])).size:
        times = np.ones(len(joined), dtype=np.int64)
        times[wide] = [len(longer[o]) for o in joined[wide].tolist()]
        at = np.cumsum(times) - times
        number, place, joined = np.repeat(number, times), np.repeat(place, times), np.repeat(joined, times)
        for i, o in zip(at[wide].tolist(), (longer[o] for o in joined[at[wide]].tolist())):
            joined[i : i + len(o)] = codes(o)
    f = table[joined]
    first = np.flatnonzero(np.diff(np.append(-1, number)) != 0) if len(number) else np.zeros(0, np.int64)
    f, number, place = np.insert(f, first, 0), np.insert(number, first, -1), np.insert(place, first, 0)
    f, number, place = np.append(f, 0).astype(np.uint32), np.append(number, -1), np.append(place, 0)
    keep = f != N
    return f[keep], number[keep], place[keep]
