"""Text repair as columns. Everything is native but NFKC, which needs a vectorised helper for rows that are not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Patterns and character sets of the matching rules.
WS = r"[\s\x1c-\x1f]"
INVISIBLE = r"[\p{Cf}\u00ad\u034f\u061c\u180e\u200b-\u200f\u2060-\u2064\u2066-\u206f\ufeff]"
DOTS = "\u3002\uff0e\uff61"
DECORATION = "<>[](){}*_`|\"'\u201c\u201d\u2018\u2019"
TRAILING = ".,!?;:'\")]>}"
QUOTE_PREFIX = r"(?md)^[ \t]*>[ \t]?"
STRIP_SPACES = rf"(?U){WS}|[\u200b-\u200f\u2060\ufeff]"
STRIP_MARKS = r"[<>\[\](){}*`|]+"
PERCENT_RUN = r"(?:%[0-9A-Fa-f]{2}){4,}"
PERCENT_BLOB = r"(?iu)%[0-9A-Za-z./:_#@%-]{7,}"
NOT_HEX = r"%(?![0-9A-Fa-f]{2})"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Unicode NFKC; ASCII is its own NFKC and never leaves the JVM's value."""
    ascii_ = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(ascii_, c).otherwise(_nfkc(F.when(~ascii_, c)))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


def nfkc_each(texts: Column) -> Column:
    """nfkc of each text of an array."""
    ascii_ = F.forall(texts, lambda t: t.isNull() | t.rlike(r"\A[\x00-\x7f]*\z"))
    return F.when(ascii_, texts).otherwise(_nfkc_each(F.when(~ascii_, texts)))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def normalize_dots(c: Column) -> Column:
    return F.translate(c, DOTS, "." * len(DOTS))


def strip_quote_prefixes(c: Column) -> Column:
    return F.regexp_replace(c, QUOTE_PREFIX, "")


def strip_decoration(c: Column) -> Column:
    return F.translate(c, DECORATION, "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def remove_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", "")


def normalize_text(c: Column) -> Column:
    return collapse_whitespace(normalize_dots(strip_invisible(nfkc(c))))


def collapse_obfuscation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, STRIP_SPACES, ""), STRIP_MARKS, "")


def percent_unquote(c: Column, rounds: int = 1) -> Column:
    """Decodes %hh; a lone % and + stay. More rounds decode what the last one brought out."""
    for _ in range(rounds):
        c = F.url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), NOT_HEX, "%25"))
    return c


def strip_trailing_punct(c: Column) -> Column:
    return F.rtrim(c, F.lit(TRAILING))


def ensure_scheme(c: Column) -> Column:
    return F.when(F.lower(c).rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def normalize_candidate_url(c: Column) -> Column:
    return F.rtrim(strip_trailing_punct(normalize_dots(c)), F.lit("\\"))


def normalize_domain(c: Column) -> Column:
    """Host name without user, port, closing dots and one www.; null if none is left."""
    lowered = F.lower(strip(c))
    full = F.when(F.instr(lowered, "://") > 0, lowered).otherwise(F.concat(F.lit("https://"), lowered))
    host = F.regexp_replace(F.regexp_extract(full, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), "^.*@", "")
    bare = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(host, "^([^:]*)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), r"^www\.", ""), F.lit(""))


def host_suffixes(domain: Column) -> Column:
    """The domain and each of its parents: a.b.c gives a.b.c, b.c and c."""
    parts = F.split(F.lower(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def first_by_key(items: Column, key) -> Column:
    """Items whose key no earlier item has. A key is made once for each item."""

    def pick(both: Column) -> Column:
        keys = both["keys"]
        return F.filter(both["items"], lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)

    return let(let(items, lambda xs: F.struct(xs.alias("items"), F.transform(xs, key).alias("keys"))), pick)


#: Names of the variants and the signals each carries.
_BASE = ["unicode_normalization", "invisible_characters", "unicode_dot_normalization"]
_NOISE = ["markdown_quote_stripping", "decoration_stripping"]
VARIANTS = (
    ("raw", []),
    ("nfkc_normalized", _BASE[:1]),
    ("invisible_stripped", _BASE[:2]),
    ("dot_normalized", _BASE),
    ("whitespace_collapsed", [*_BASE, "whitespace_collapsed"]),
    ("whitespace_removed", [*_BASE, "whitespace_flattening"]),
    ("formatting_noise_stripped", [*_BASE, *_NOISE]),
    ("formatting_noise_flattened", [*_BASE, *_NOISE, "whitespace_flattening"]),
)


def scan_variants(raw: Column, normal: Column | None = None) -> Column:
    """The ordered variants of a text without empty ones and repeats. normal: its NFKC, if it is at hand."""
    n = nfkc(raw) if normal is None else normal
    i = strip_invisible(n)
    d = normalize_dots(i)
    s = strip_decoration(strip_quote_prefixes(d))
    made = (raw, n, i, d, collapse_whitespace(d), remove_whitespace(d), collapse_whitespace(s), remove_whitespace(s))
    arrays = [
        F.struct(F.lit(name).alias("name"), text.alias("text"), F.array(*map(F.lit, signals)).cast("array<string>").alias("signals"))
        for (name, signals), text in zip(VARIANTS, made, strict=True)
    ]
    return first_by_key(F.filter(F.array(*arrays), lambda v: v["text"] != ""), lambda v: v["text"])


def detection_texts(c: Column) -> Column:
    """The text, its collapsed form, and for each of these the percent runs decoded, and collapsed; each text once."""
    both = F.array_distinct(F.concat(F.array(c), F.filter(F.array(collapse_obfuscation(c)), lambda t: t != "")))

    def more(texts: Column) -> Column:
        runs = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(PERCENT_RUN), F.lit(0))))
        decoded = F.flatten(F.transform(runs, lambda r: let(percent_unquote(r, 3), lambda d: F.array(d, collapse_obfuscation(d)))))
        return F.array_distinct(F.concat(texts, F.filter(decoded, lambda t: t != "")))

    return let(both, more)


def decoded_substrings(c: Column) -> Column:
    """Percent blobs cleaned of lone % and decoded once; only those that begin with %hh and hold at least four."""
    clean = F.transform(F.regexp_extract_all(c, F.lit(PERCENT_BLOB), F.lit(0)), lambda b: F.regexp_replace(b, NOT_HEX, ""))
    fit = F.filter(clean, lambda b: b.rlike("^%[0-9A-Fa-f]{2}") & (F.regexp_count(b, F.lit("%[0-9A-Fa-f]{2}")) >= 4))
    decoded = F.transform(fit, lambda b: let(percent_unquote(b), lambda d: F.when(d != b, d)))
    return F.array_distinct(F.filter(decoded, lambda t: t.isNotNull()))
