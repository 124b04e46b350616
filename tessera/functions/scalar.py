"""Scalar building blocks as column expressions: codes, names, keys, ids. Null-safe unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The enzyme-class expressions that results must agree on.
EC_ANY = r"(?:EC[:\s]*)?(\d+\.\d+\.\d+(?:\.\d+)?)"
EC_PREFIXED = r"EC[:\s-]?(\d+\.\d+\.\d+\.\d+|\d+\.\d+\.\d+\.-)"
EC_BOUNDED = r"\b(\d+\.\d+\.\d+\.[\d\-]+)\b"
EC_OPEN = r"(\d+\.\d+\.\d+\.[\d-]+)"
EC_INLINE = r"(?i)\s*\(?EC[:\s]*\d+\.\d+\.\d+\.[\d\-]+\)?"

#: Fixed value: the namespace of cluster ids.
CLUSTER_NAMESPACE = "6f6e746f-6d61-7063-6c75-737465720001"

#: Descriptions that say nothing.
TRIVIAL = [
    "",
    "hypothetical protein",
    "putative protein",
    "protein of unknown function",
    "uncharacterized protein",
    "unknown",
    "unknown function",
    "n/a",
    "na",
    "none",
]

#: Words that mark a description as no enzyme, and words that mark it as one all the same.
NON_ENZYME_WORDS = [
    r"transcriptional\s+regulator",
    r"\bregulator\b",
    "hypothetical",
    "uncharacterized",
    r"DUF\d+",
    "CRISPR",
    r"ribosomal\s+protein",
    r"sigma\s+factor",
    "chaperone",
    "porin",
    "pilus",
    "flagell",
    r"signal\s+peptide",
    r"signal\s+recognition",
    r"\bouter\s+membrane\s+protein\b",
    r"\binner\s+membrane\s+protein\b",
    "histone-like",
    "nucleoid-associated",
    r"phage\s+protein",
    r"structural\s+protein",
    r"hypothetical\s+protein",
]
ENZYME_WORDS = [
    r"EC\s*\d+\.",
    "reductase",
    "transferase",
    "kinase",
    "synthase",
    "hydrolase",
    "isomerase",
    "dehydrogenase",
    "peroxidase",
    "oxidase",
    "ligase",
    "polymerase",
    "protease",
    "peptidase",
    "nuclease",
    "phosphatase",
    "carboxylase",
    "decarboxylase",
    "esterase",
    "lipase",
    "amidase",
    "aldolase",
    "epimerase",
    "mutase",
    "lyase",
    "transaminase",
    "aminotransferase",
    "cyclase",
    "dismutase",
    "methylthiotransferase",
]
NON_ENZYME, ENZYME = (f"(?i)({'|'.join(w)})" for w in (NON_ENZYME_WORDS, ENZYME_WORDS))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_all(text: Column | str, pattern: str) -> Column:
    """Distinct first groups in order of appearance; null text gives an empty array."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), F.lit(1)))


def norm_key(text: Column | str) -> Column:
    """Lower case, ``(+)`` and ``(-)`` off, then only a-z and 0-9."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"\([+-]\)", ""), "[^a-z0-9]+", "")


def clean_name(text: Column | str) -> Column:
    """Inline enzyme codes, emptied brackets and double spaces off; the text itself where nothing is left."""
    t = _c(text)
    out = F.regexp_replace(t, r"(?i)\[EC[^\]]*\]", "")
    out = F.regexp_replace(out, EC_INLINE, "")
    out = F.regexp_replace(out, r"\(\s*\)|\[\s*\]", "")
    out = F.trim(F.regexp_replace(out, r"\s{2,}", " "))
    return F.coalesce(F.nullif(out, F.lit("")), t)


def safe_short(text: Column | str, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(_c(text), r"[^\p{L}\p{N}\-_.]", "_"), "_+", "_"), 1, most)


def expand_ec(ec: Column | str) -> Column:
    """The code and its ancestors: ``EC a.b.c.d a.b.c.- a.b.-.- a.-.-.-``."""
    p = F.split(_c(ec), r"\.")
    one, two, three = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
    up = [F.concat(F.concat_ws(".", one, two, three), F.lit(".-")), F.concat(F.concat_ws(".", one, two), F.lit(".-.-")), F.concat(one, F.lit(".-.-.-"))]
    return F.concat_ws(" ", F.concat(F.lit("EC "), _c(ec)), *up)


def shared_levels(a: Column | str, b: Column | str, levels: int = 4) -> Column:
    """Leading levels that two codes share; ``-`` and ``*`` end the comparison."""
    x, y = F.split(_c(a), r"\."), F.split(_c(b), r"\.")
    out: Column = F.lit(0)
    for n in range(levels, 0, -1):
        same = [(F.get(x, F.lit(i)) == F.get(y, F.lit(i))) & ~F.get(x, F.lit(i)).isin("-", "*") for i in range(n)]
        whole = same[0]
        for s in same[1:]:
            whole = whole & s
        out = F.when(F.coalesce(whole, F.lit(False)) & (out == 0), F.lit(n)).otherwise(out) if n < levels else F.when(F.coalesce(whole, F.lit(False)), F.lit(n)).otherwise(0)
    return out


def hierarchy_match(a: Column | str, b: Column | str) -> Column:
    """Largest share of levels over all pairs of two code arrays."""
    x, y = _c(a), _c(b)
    per = F.transform(x, lambda p: F.coalesce(F.array_max(F.transform(y, lambda q: shared_levels(p, q))), F.lit(0)))
    return F.coalesce(F.array_max(per), F.lit(0)) / 4.0


def match_level(a: Column | str, b: Column | str) -> Column:
    """2: a code in both arrays; 1: a code of one is part of a code of the other; else 0."""
    x, y = _c(a), _c(b)
    part = F.exists(x, lambda p: F.exists(y, lambda q: F.contains(q, p) | F.contains(p, q)))
    return F.when(F.coalesce(F.arrays_overlap(x, y), F.lit(False)), 2).when(F.coalesce(part, F.lit(False)), 1).otherwise(0)


def uuid5(key: Column | str) -> Column:
    """Name-based UUID (SHA-1) in the cluster namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(CLUSTER_NAMESPACE.replace("-", ""))), F.encode(_c(key), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def predicate(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.85, "skos:exactMatch").when(s >= 0.65, "skos:closeMatch").otherwise("skos:relatedMatch")


def gold_bucket(n: Column | str) -> Column:
    n = _c(n)
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").otherwise("11+")


def compose(name: Column | str, ec: Column | str, tags: Column | str, notes: Column | str) -> Column:
    """``name (EC x) [tag; tag] (notes)``; parts that are null or blank stay out, and nothing at all gives null."""
    n, e, t, o = (F.nullif(F.trim(_c(x)), F.lit("")) for x in (name, ec, F.array_join(_c(tags), "; "), notes))
    code = F.when(F.lower(e).startswith("ec"), e).otherwise(F.concat(F.lit("EC "), e))
    head = F.when(n.isNotNull() & e.isNotNull(), F.concat(n, F.lit(" ("), code, F.lit(")"))).otherwise(F.coalesce(n, code))
    return F.nullif(F.concat_ws(" ", head, F.concat(F.lit("["), t, F.lit("]")), F.concat(F.lit("("), o, F.lit(")"))), F.lit(""))
