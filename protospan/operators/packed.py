"""Several values packed in one field: one row per value, position kept.

The delimiter of a source (say, one run's field) is inferred by scoring candidates: how many rows it
supports, how regular the pieces are that it cuts, and how consistent its piece count is with the
number of separator places of the row. Rows are cut by their source's delimiter; a row that leaves an
irregular piece (it mixes delimiters, or differs from its source) is cut at every separator place.

Scale: candidates are scored by one aggregation with map-side combine; only rows that can hold several
values reach the join with the inferred delimiters, which AQE may broadcast by its measured size and
splits where a source is hot. Patterns are possessive, so very long texts neither backtrack nor recurse.

Defined results: null, blank and 'no value' fields and fields with fewer than two values that are not
empty give no rows; an empty place counts in the position; a quote without its partner is a character;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protospan.functions.missing import no_text, strip

# fixed values: candidate delimiters
CANDIDATES = {"semicolon": ";", "comma": ",", "bar": "|", "slash": "/", "wide_semicolon": "；", "wide_comma": "，", "plus": "+", "colon": ":", "ampersand": "&"}

ITEM = r"^(?:[\p{L}\p{N}\-]*|\"[^\"]*\"|'[^']*')$"
SEPARATOR = r"[^\p{L}\p{N}\-\"'\s]"
QUOTED = r"^(?:\"([^\"]*)\"|'([^']*)')$"


def _cut(text: Column, inside: str, outside: str) -> Column:
    """Pieces between delimiters outside quotes. ``inside``: class body of the delimiter's characters; ``outside``: its complement."""
    pattern = f"[{inside}]((?:[{outside}]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def cut_by(text: Column, delimiter: str) -> Column:
    """Pieces of ``text`` by one delimiter character, quotes respected, blanks stripped."""
    d = "\\" + delimiter if delimiter in "|/+&;:," else delimiter
    return F.transform(_cut(F.concat(F.lit(delimiter), text), d, f"^{d}\"'"), strip)


def cut_everywhere(text: Column) -> Column:
    """Pieces of ``text`` at every separator place: one per separator character, or blanks alone between values."""
    inside = r"^\p{L}\p{N}\-\"'\s"
    outside = r"\p{L}\p{N}\-\s"
    pieces = F.transform(_cut(F.concat(F.lit(";"), text), inside, outside), strip)
    by_blank = F.transform(pieces, lambda p: F.when(p.rlike(QUOTED) | ~p.rlike(r"(?U)\s"), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(r"\"[^\"]*+\"|'[^']*+'|[^\s]++"), F.lit(0))))
    return F.flatten(by_blank)


def regular(pieces: Column) -> Column:
    """True where every piece is a plain value, one quoted value or empty."""
    return F.forall(pieces, lambda p: p.rlike(ITEM))


def infer_delimiters(rows: DataFrame, source: list[str], text: str) -> DataFrame:
    """source columns, delimiter, score, rows: the best candidate of each source.

    score = supporting rows x share of rows whose pieces are all regular x share of rows where the
    candidate's piece count equals that of all separator places. Ties: more rows, then the candidate's
    place in ``CANDIDATES``.
    """
    place = F.size(cut_everywhere(F.col(text)))
    rows = rows.withColumn("__n", place)
    trials = []
    for at, d in enumerate(CANDIDATES.values()):
        pieces = cut_by(F.col(text), d)
        trials.append(F.when(F.col(text).contains(d), F.struct(F.lit(-at).alias("at"), F.lit(d).alias("d"), F.size(pieces).alias("n"), regular(pieces).alias("ok"))))
    each = rows.select(*source, "__n", F.explode(F.filter(F.array(*trials), lambda t: t.isNotNull())).alias("t"))
    each = each.filter(F.col("t.n") > 1)
    scored = each.groupBy(*source, F.col("t.d").alias("delimiter"), F.col("t.at").alias("__at")).agg(
        F.count("*").alias("rows"),
        F.avg(F.col("t.ok").cast("double")).alias("__regular"),
        F.avg((F.col("t.n") == F.col("__n")).cast("double")).alias("__same"),
    )
    scored = scored.withColumn("score", F.col("rows") * F.col("__regular") * F.col("__same"))
    best = scored.groupBy(*source).agg(F.max_by(F.struct("delimiter", "score", "rows"), F.struct("score", "rows", "__at")).alias("b"))
    return best.select(*source, "b.delimiter", "b.score", "b.rows")


def unpack(df: DataFrame, row_id: str, source: str, fields: list[str]) -> DataFrame:
    """(row_id, field_name, position, item) of every field with at least two values that are not empty."""
    q = lambda c: F.col(f"`{c}`")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), q(f).cast("string").alias("__text")) for f in fields]))
    rows = df.select(q(row_id).alias(row_id), q(source).alias("__source"), each.alias("__f")).select(row_id, "__source", "__f.field_name", "__f.__text")
    rows = rows.filter(F.col("__text").rlike(r"(?U)[^\p{L}\p{N}\-]") & ~no_text(F.col("__text")))
    found = infer_delimiters(rows, ["__source", "field_name"], "__text").select(F.col("__source").alias("__s"), F.col("field_name").alias("__fn"), "delimiter")
    joined = rows.join(found, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("field_name") == F.col("__fn")), "left")
    own = F.lit(None).cast("array<string>")
    for d in CANDIDATES.values():
        own = F.when(F.col("delimiter") == d, cut_by(F.col("__text"), d)).otherwise(own)
    pieces = joined.select(row_id, "field_name", "__text", own.alias("__own"))
    pieces = pieces.withColumn("__p", F.when(regular(F.col("__own")) & ~F.col("__text").rlike(r"^\s*[\"'][^\"']*[\"']\s*$"), F.col("__own")).otherwise(cut_everywhere(F.col("__text"))))
    clean = F.transform("__p", lambda p: strip(F.regexp_replace(p, QUOTED, "$1$2")))
    items = pieces.select(row_id, "field_name", clean.alias("__i")).filter(F.size(F.filter("__i", lambda p: p != "")) >= 2)
    out = items.select(row_id, "field_name", F.posexplode("__i").alias("__pos", "item")).filter(F.col("item") != "")
    return out.select(row_id, "field_name", (F.col("__pos") + 1).alias("position"), "item")
