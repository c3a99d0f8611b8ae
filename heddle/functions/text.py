"""Scalar text functions. Built-in expressions where Spark has them; Arrow UDFs for Unicode forms that it lacks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from encodings import idna
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# fixed values: legal suffixes, longest first within each language
ENGLISH_SUFFIXES = ["company limited", "incorporated", "company ltd", "corporation", "co limited", "limited", "co ltd", "corp", "ltd", "llc", "inc", "co"]
CHINESE_SUFFIXES = ["股份有限公司", "有限责任公司", "实业有限公司", "有限公司", "集团", "公司", "工厂", "厂"]
# fixed values: names and codes of countries
COUNTRIES = {
    "cn": "CN", "china": "CN", "mainland china": "CN", "peoples republic of china": "CN", "people s republic of china": "CN", "pr china": "CN", "prc": "CN",
    "hk": "HK", "hong kong": "HK", "hong kong sar": "HK",
    "mo": "MO", "macau": "MO", "macao": "MO",
    "tw": "TW", "taiwan": "TW",
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "gb": "GB", "uk": "GB", "united kingdom": "GB",
    "bd": "BD", "bangladesh": "BD",
    "ca": "CA", "canada": "CA",
    "au": "AU", "australia": "AU",
    "de": "DE", "germany": "DE",
    "fr": "FR", "france": "FR",
    "in": "IN", "india": "IN",
    "it": "IT", "italy": "IT",
    "es": "ES", "spain": "ES",
    "pk": "PK", "pakistan": "PK",
    "vn": "VN", "vietnam": "VN",
}


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def _base_letters() -> dict[str, str]:
    """Accented Latin letters and what is left of them, by rule: one base letter and combining marks in their decomposition."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            out[chr(code)] = parts[0].lower()
    return out


_BASE = _base_letters()


def without_accents(c: Column) -> Column:
    """Lower case, Latin letters without their marks: how the search index sees text. No Python worker."""
    plain = F.translate(c, "".join(_BASE), "".join(_BASE.values()))
    return F.regexp_replace(F.lower(plain), r"\p{M}+", "")


def plain_text(text: str) -> str:
    """without_accents of a string."""
    plain = text.translate(str.maketrans(_BASE)).lower()
    return "".join(c for c in plain if unicodedata.category(c)[0] != "M")


def whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def without_punctuation(c: Column) -> Column:
    return whitespace(F.regexp_replace(c, r"[\p{P}\p{S}]", " "))


def search_text(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, punctuation and symbols to spaces, case-folded. ascii_only promises that c is ASCII and spares the UDFs."""
    return F.lower(without_punctuation(c)) if ascii_only else whitespace(casefold(without_punctuation(nfkc(c))))


def sought_text(text: str) -> Column:
    """search_text of a text that is known beforehand: no worker is asked for each row."""
    return whitespace(without_punctuation(F.lit(unicodedata.normalize("NFKC", text).casefold())))


def company_name(c: Column, ascii_only: bool = False) -> Column:
    """struct<original, nfkc, normalized, suffix_removed>: one Chinese suffix goes, then one English one; an English one is the one that is named."""
    full = whitespace(c if ascii_only else nfkc(c))
    bare = full
    if not ascii_only:
        bare = F.regexp_replace(full, f"(?:{'|'.join(CHINESE_SUFFIXES)})$", "")
    english = "|".join(ENGLISH_SUFFIXES)
    normal = F.regexp_replace(search_text(bare, ascii_only), f"(?:^| )(?:{english})$", "")
    named = F.nullif(F.regexp_extract(search_text(full, ascii_only), f"(?:^| )({english})$", 1), F.lit(""))
    if not ascii_only:
        named = F.coalesce(named, F.nullif(F.regexp_extract(full, f"({'|'.join(CHINESE_SUFFIXES)})$", 1), F.lit("")))
    return F.struct(c.alias("original"), full.alias("nfkc"), normal.alias("normalized"), named.alias("suffix_removed"))


def country_code(c: Column) -> Column:
    """Two letters pass as they are, upper-cased (so UK stays UK); other names by the table, else null."""
    clean = whitespace(F.lower(F.regexp_replace(c, "[.'’]", " ")))
    names = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.when(clean.rlike(r"^\p{L}{2}$"), F.upper(clean)).otherwise(F.try_element_at(names, clean))


@F.pandas_udf(StringType())
def _to_ascii_host(hosts: pd.Series) -> pd.Series:
    def one(host):
        try:
            return ".".join(idna.ToASCII(label).decode() for label in host.split("."))
        except UnicodeError:
            return None

    return hosts.map(one, na_action="ignore")


def domain(c: Column, ascii_only: bool = False) -> Column:
    """Host of a URL or bare host: no user, port, trailing dots or leading www., lower case, at least one dot, no empty label."""
    raw = F.trim(c)
    rest = F.when(F.contains(raw, F.lit("://")), F.substring_index(raw, "://", -1)).otherwise(F.regexp_replace(raw, "^//", ""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    ok = host.rlike(r"^[^.]+(\.[^.]+)+$")
    return F.when(ok, host if ascii_only else _to_ascii_host(host))


def iso_time(c: Column) -> Column:
    """An ISO time; one without an offset is UTC; null if it is none."""
    named = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(named)


def address(c: Column, ascii_only: bool = False) -> Column:
    return whitespace(F.replace(c if ascii_only else nfkc(c), F.lit("\n"), F.lit(", ")))


def masked_address(c: Column, keep: int = 3, ascii_only: bool = False) -> Column:
    """The last segments after ***; without enough commas the last three words after ***, numbers masked, or *** alone."""
    full = address(c, ascii_only)
    parts = F.filter(F.transform(F.split(full, ","), lambda p: F.trim(p)), lambda p: p != "")
    words = F.split(whitespace(F.regexp_replace(full, r"\b\d+[A-Za-z0-9/-]*\b", "***")), " ")
    tail = lambda a, n: F.slice(a, -n, n)
    line = F.when(F.size(words) <= 4, "***").otherwise(F.concat_ws(" ", F.lit("***"), tail(words, 3)))
    return F.when(F.size(parts) > keep, F.concat_ws(", ", F.lit("***"), tail(parts, keep))).otherwise(line)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower case, without accents."""
    return F.filter(F.split(without_accents(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bigram_dice(a: Column, b: Column) -> Column:
    """2 * |common bigrams| / (|bigrams of a| + |bigrams of b|), bigrams counted as often as they occur."""
    grams = lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    ga, gb = grams(F.regexp_replace(a, r"\s+", " ")), grams(F.regexp_replace(b, r"\s+", " "))
    times = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
    common = F.aggregate(F.array_intersect(ga, gb), F.lit(0), lambda n, g: n + F.least(times(ga, g), times(gb, g)))
    either = F.size(ga) + F.size(gb)
    return F.when(a == b, 1.0).when((F.size(ga) == 0) | (F.size(gb) == 0), 0.0).otherwise(2.0 * common / either)


@lru_cache(1 << 16)
def _dice(a: str, b: str) -> float:
    if a == b:
        return 1.0
    grams = [Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (re.sub(r"\s+", " ", x, flags=re.ASCII) for x in (a, b))]
    sizes = [sum(g.values()) for g in grams]
    return 2.0 * sum((grams[0] & grams[1]).values()) / sum(sizes) if all(sizes) else 0.0


@F.pandas_udf(DoubleType())
def name_dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """bigram_dice of two texts, for pairs of few different names: those met lately are not compared again."""
    return pd.Series([_dice(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; for what similarity_bound leaves."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity_bound(a: Column, b: Column) -> Column:
    """What sequence_ratio is at most: matching blocks have no more of a letter than either text has."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    letters = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    both = F.length(a) + F.length(b)
    short = 2.0 * F.least(F.length(a), F.length(b)) / both  # the lengths alone, before letters are counted
    return F.when(both == 0, 0.0).when(short < 0.5, short).otherwise(2.0 * common / both)


def context_window(text: Column, needle: Column, radius: int = 90, low: Column | None = None) -> Column:
    """radius characters to either side of the needle's first place, whatever its case; empty if it isn't there. low: the text in lower case, if it is at hand."""

    def window(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - radius)
        return F.when(at > 0, F.trim(F.substr(text, start, at - start + F.length(needle) + radius))).otherwise("")

    at = F.instr(F.lower(text) if low is None else low, F.lower(needle))
    return F.get(F.transform(F.array(at), window), F.lit(0))  # the place is looked for once
