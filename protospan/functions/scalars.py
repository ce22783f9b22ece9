"""Scalar functions over accessions, genes, wells, texts and statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: species endings of entry names
SPECIES = r"_(?:HUMAN|MOUSE|RAT|BOVIN|PIG|YEAST|ECOLI)$"


def split_group(c: Column) -> Column:
    """Members of a group text split on ';' or ',', trimmed, empty ones dropped; null stays null."""
    return F.filter(F.transform(F.split(c, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def gene_of(c: Column) -> Column:
    """A gene symbol from an entry: without its species ending."""
    return F.regexp_replace(c, SPECIES, "")


def accession(c: Column) -> Column:
    """The accession of 'sp|ACC|NAME' or of a bare accession."""
    return F.when(c.rlike(r"^(?:sp|tr)\|"), F.split_part(c, F.lit("|"), F.lit(2))).otherwise(c)


def with_isoform_base(c: Column) -> Column:
    """Accession tokens of a group and, of isoforms such as P02768-2, the base too; distinct, sorted."""
    parts = F.transform(split_group(c), lambda x: accession(x))
    bases = F.transform(parts, lambda x: F.regexp_replace(x, r"-\d+$", ""))
    return F.array_sort(F.array_distinct(F.concat(parts, bases)))


def best_accession(c: Column) -> Column:
    """The first reviewed ('sp|') member, else the first member."""
    parts = split_group(c)
    reviewed = F.filter(parts, lambda x: x.startswith("sp|"))
    return accession(F.coalesce(F.get(reviewed, F.lit(0)), F.get(parts, F.lit(0))))


def well(c: Column) -> Column:
    """Letter and number without zeros or separators: 'c-01' is C1; null for other texts."""
    p = r"(?i)^\s*([A-P])[\s_\-]*0*(\d{1,2})\s*$"
    return F.when(F.regexp_extract(c, p, 1) != "", F.concat(F.upper(F.regexp_extract(c, p, 1)), F.regexp_extract(c, p, 2)))


def flat(c: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")


def natural_key(c: Column) -> Column:
    """Text whose order is natural: a run of digits becomes its length without leading zeros, then these digits."""
    digits = lambda x: F.ltrim(x, F.lit("0"))
    piece = lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0)), piece), "")


def trailing_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)\s*$", 1).try_cast("double")


def url_list(c: Column) -> Column:
    """Members of a comma list, unescaped."""
    return F.transform(F.split(c, ","), lambda x: F.try_url_decode(F.trim(x)))


def csv_field(c: Column) -> Column:
    """A field quoted by RFC 4180 where it must be."""
    return F.when(c.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def file_identity(content: Column) -> Column:
    return F.sha2(content, 256)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(universe: int, marked: int, drawn: int, hits: int) -> float:
    """P(X >= hits); 1 for degenerate cases."""
    if universe <= 0 or marked <= 0 or drawn <= 0 or hits <= 0 or marked > universe or drawn > universe:
        return 1.0
    base, total = log_choose(universe, drawn), 0.0
    for k in range(max(hits, drawn + marked - universe), min(marked, drawn) + 1):
        total += math.exp(log_choose(marked, k) + log_choose(universe - marked, drawn - k) - base)
    return min(1.0, total)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared, by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, y = df / 2, x / 2
    lead = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        for n in range(1, 500):
            term *= y / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * lead)
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, lead * h)


@F.pandas_udf(T.DoubleType())
def hypergeometric_p(universe: pd.Series, marked: pd.Series, drawn: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(universe, marked, drawn, hits)])


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(a), float(b)) for a, b in zip(x, df)])
