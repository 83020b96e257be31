"""Identifier and name normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# fixed values: resolver prefixes stripped from a DOI, in this order
DOI_PREFIXES = ("https://doi.org/", "http://dx.doi.org/", "http://doi.org/", "doi.org/")
_FOLDED = [(c, f) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()
           and len(f := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()) == 1]
# lower-case Latin letters whose compatibility decomposition holds one plain letter, and that letter
ACCENTED, PLAIN = ("".join(x) for x in zip(*_FOLDED))
# fixed values: phrases that say nothing about which institution is meant
INSTITUTION_NOISE = ("university of", "the ", "college", "school", "institute", ",", ".")
ORCID = r"^(?:https?://orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dX])$"


def norm_doi(raw: Column) -> Column:
    """Trim, lower, strip resolver prefixes; absent spellings become ''."""
    d = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    stripped = d
    for p in DOI_PREFIXES:
        stripped = F.replace(stripped, F.lit(p), F.lit(""))
    return F.when(d.isin("", "nan", "0", "none"), "").otherwise(stripped)


def norm_digits(raw: Column) -> Column:
    """Digits only; a bare 0 is absent."""
    d = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    return F.when(d == "0", "").otherwise(d)


def norm_orcid(raw: Column) -> Column:
    m = F.regexp_extract(F.trim(raw), ORCID, 1)
    return F.when(m != "", m)


def fold_name(raw: Column) -> Column:
    """Lower case, Latin accents folded, what has no plain letter dropped, spaces collapsed."""
    low = F.translate(F.lower(F.coalesce(raw, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\x00-\x7F]", ""), r"\s+", " "))


def letters_only(raw: Column) -> Column:
    """Folded name reduced to a-z and space."""
    return F.trim(F.regexp_replace(fold_name(raw), "[^a-z ]", ""))


@F.pandas_udf(T.StringType())
def fold_name_nfkd(names: pd.Series) -> pd.Series:
    """Full compatibility folding, for names outside the table."""
    return (names.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
            .str.replace(r"\s+", " ", regex=True).str.strip())


def inst_tokens(raw: Column) -> Column:
    """Tokens longer than three letters after the noise phrases are removed."""
    s = fold_name(raw)
    for noise in INSTITUTION_NOISE:
        s = F.replace(s, F.lit(noise), F.lit(" "))
    return F.array_distinct(F.filter(F.split(F.trim(s), r"\s+"), lambda t: F.length(t) > 3))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))


@F.pandas_udf(T.DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two names."""
    from difflib import SequenceMatcher
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""))])
