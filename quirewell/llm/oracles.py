"""SQL for the queries that SQL can express; look-alikes as tables of characters."""

from __future__ import annotations

#: Fixed values, apart from those of the operator: for each Latin letter the code points (Cyrillic, Greek, Armenian) that are drawn like it.
DRAWN_LIKE = {
    "A": "0410 0391", "B": "0412 0392", "C": "0421 03F9", "E": "0415 0395", "G": "050C", "H": "041D 0397", "I": "0406 04C0 0399", "J": "0408 037F", "K": "041A 039A", "M": "041C 039C", "N": "039D", "O": "041E 039F", "P": "0420 03A1", "Q": "051A", "S": "0405", "T": "0422 03A4", "W": "051C", "X": "0425 03A7", "Y": "04AE 03A5", "Z": "0396",
    "a": "0430 03B1", "c": "0441 03F2", "d": "0501", "e": "0435", "h": "04BB 0570", "i": "0456", "j": "0458 03F3", "l": "04CF", "n": "0578", "o": "043E 03BF 0585", "p": "0440 03C1", "q": "051B", "s": "0455", "u": "057D", "v": "03BD", "w": "051D", "x": "0445", "y": "0443",
    "-": "2010 2011", "/": "2044 2215",
}
_PAIRS = [(chr(int(code, 16)), letter) for letter, codes in DRAWN_LIKE.items() for code in codes.split()]
LOOKALIKE_FROM, LOOKALIKE_TO = ("".join(p[i] for p in _PAIRS if p[1].isalpha()) for i in (0, 1))
PUNCTUATION_FROM, PUNCTUATION_TO = ("".join(p[i] for p in _PAIRS if not p[1].isalpha()) for i in (0, 1))
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE).replace("'", "''")
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
IGNORABLE = "".join(map(chr, [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))
#: Radicals and the characters they are drawn like.
RADICALS_FROM, RADICALS_TO = "⼦⽂⽊⽯⾥⾧", "子文木石里長"


def look(text: str) -> str:
    """A text without ignorable characters, look-alikes replaced."""
    plain = f"regexp_replace(translate(nfc_normalize({text}), '{SPACES}', '{' ' * len(SPACES)}'), '[{IGNORABLE}]', '', 'g')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        plain = f"replace({plain}, '{a}', '{b}')"
    return f"nfc_normalize(translate({plain}, '{WIDE}{LOOKALIKE_FROM}{RADICALS_FROM}{PUNCTUATION_FROM}', '{NARROW}{LOOKALIKE_TO}{RADICALS_TO}{PUNCTUATION_TO}'))"


def words(text: str) -> str:
    """Words apart from case and punctuation; a small letter whose capital looks Latin is that Latin letter."""
    pairs = [(a.lower(), b.lower()) for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO) if a.isupper() and a.lower() not in LOOKALIKE_FROM]
    a, b = ("".join(p[i] for p in pairs) for i in (0, 1))
    return f"list_filter(list_transform(string_split_regex(translate(lower(strip_accents({look(text)})), '{a}', '{b}'), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')), lambda w: w <> '')"


P2 = """WITH v AS (SELECT vec_id, mask_emb::FLOAT[64] AS e FROM mask_batch WHERE len(mask_emb) = 64 AND len(list_filter(mask_emb, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(mask_emb, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rank FROM s)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE rank <= 5 AND c >= 0.9"""
P5 = """WITH RECURSIVE a AS (SELECT document_id, lower(trim(source)) AS source, correspondent, sampled_pairs FROM articles),
k AS (SELECT DISTINCT document_id, 's' || source AS key FROM a WHERE source IS NOT NULL UNION SELECT document_id, 'c' || correspondent FROM a WHERE correspondent IS NOT NULL
 UNION SELECT document_id, 'p' || p.pers_entity_id FROM (SELECT document_id, unnest(sampled_pairs) AS p FROM a) WHERE p.pers_entity_id IS NOT NULL UNION SELECT document_id, 'q' || p.pers_wikidata_QID FROM (SELECT document_id, unnest(sampled_pairs) AS p FROM a) WHERE p.pers_wikidata_QID IS NOT NULL),
e AS (SELECT DISTINCT x.document_id AS a, y.document_id AS b FROM k x JOIN (SELECT key, min(document_id) AS document_id FROM k GROUP BY key) y USING (key)), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT document_id AS a, document_id AS b FROM a UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
SELECT reach.a AS document_id, min(source) AS group_source FROM reach JOIN a ON a.document_id = reach.b GROUP BY reach.a"""
P9 = f"""WITH s AS (SELECT doc_id, text, {look("text")} AS look FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b USING (look) WHERE a.doc_id < b.doc_id AND a.text <> b.text"""
P8 = f"""WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, lang, {words("text")} AS w FROM eval_item WHERE text <> ''),
dc AS (SELECT doc_id, array_to_string(w, '') AS c FROM d), ic AS (SELECT item_id, array_to_string(w, '') AS c FROM i WHERE lang IN ('zh', 'ja', 'th')),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[n:n + 11], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 11)) AS n)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[n:n + 11], ' ') AS g FROM i, LATERAL (SELECT unnest(generate_series(1, len(w) - 11)) AS n) WHERE lang NOT IN ('zh', 'ja', 'th')),
dl AS (SELECT DISTINCT doc_id, substr(c, n, 24) AS g FROM dc, LATERAL (SELECT unnest(generate_series(1, length(c) - 23)) AS n) WHERE regexp_matches(c, '[\\x{{3040}}-\\x{{9FFF}}\\x{{0E00}}-\\x{{0E7F}}]')),
il AS (SELECT DISTINCT item_id, substr(c, n, 24) AS g FROM ic, LATERAL (SELECT unnest(generate_series(1, length(c) - 23)) AS n))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g) UNION SELECT DISTINCT doc_id, item_id FROM dl JOIN il USING (g)"""
ORACLE = {"p2_found": P2, "p5_found": P5, "p8_found": P8, "p9_found": P9}
