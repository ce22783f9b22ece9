"""Texts cut off by a field limit or a broken transfer.

Two kinds of evidence tell that a text lost its end. A vocabulary trie, held as a table with one row per node (prefix),
tells whether the final token is an unknown proper prefix of known words, and a table of token pairs whether texts go
on after the last pair or stop there. Lengths that pile up in a source, against its texts of nearly that length, tell
of a limit. Marks of clipping, and the closing form that a source's texts share (the first word of the last lines, the
last character), only add to that: a form counts where the texts without it mostly carry evidence of their own.

Scale: each distinct text counts once (copies by a 128-bit hash and the length). Texts meet one shuffle, for the
corpus' counts; everything else carries rows of features without text. Counts combine map-side; the trie is never
gathered, only its nodes that equal a final token are joined, and no stopped text takes part in those joins. Learned
tables have a few rows per source. Texts are read whole; patterns are possessive, bounded or on one line's first word.

Defined results: null, empty and blank texts are no case; a complete text without a final stop, a short phrase and
a text just as long as a limit are no case; a copy of a cut text is one; texts of a null source have no closing form;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.functions.lineage import cut_lineage

# fixed values: marks that systems put behind a text, which say nothing about its end, and the characters they end in
FOOTER = r"(?:(?<!\s)\s*+(?:\[saved\]|[Rr]efs?: \[\d{1,4}\](?:,? ?\[\d{1,4}\])*+,?|\(see [^()\n]{1,40}\)|[:;]-?[)(DP]|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]))++$"
FOOTER_END = r"[\])(DP,\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
# fixed values: marks of clipping; a mark in brackets has 60 characters at most by its pattern
CLIPPED = r"(?:…|\.\.\.|\x{FFFD}|\[[^\[\]\n]{0,30}(?:clipped|truncated|cut off|continued|more)[^\[\]\n]{0,10}\]|\((?:truncated|continued|more)\))$"
MARK = 60
BLANKS = " \t\n\r\x0b\x0c\x00​﻿ 　"
STOPS = list(".?!。？！")
CLOSERS = "\"'”’»)]`*_"
NUMBER = r"\d+(?:[.,:]\d+)*+"
TOKEN = r"[a-z0_\-'’]++(?![\p{L}\p{M}])|\p{IsHan}|[[\p{L}\p{M}\d_\-'’]&&[^\p{IsHan}]]++|[.?!。？！]++|\n++"
STOP = r"^[.?!。？！\n]"
WINDOW = 120  # characters of the end that are cut into tokens first; a text whose last two tokens are longer is cut whole
FORMS = ("last_char", "last_word", "before_word")
CLOSING_SHARE = 0.75
LACKING = 0.5  # of the texts without a form so many must carry evidence of their own
LEAST_TEXTS = 4
USUAL_END = 0.02
PHRASE = 60
CONTEXT = 3
REPEATED, LEAST_COPIES = 5000, 3  # a repeated phrase has one in so many of all rows, and so many rows at least


def source_key(c: Column) -> Column:
    """Spellings of one source: letters in lower case, anything else one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def _trimmed(text: Column) -> Column:
    """Without blanks at the end; most texts have none and are passed on as they are."""
    return F.when(F.right(text, F.lit(1)).isin(*BLANKS), F.rtrim(text, F.lit(BLANKS))).otherwise(text)


def tokens_of(text: Column) -> Column:
    """Words in lower case with digits alike, runs of stops, line ends."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), NUMBER, "0"), F.lit(TOKEN), F.lit(0))


def _is_stop(token: Column) -> Column:
    return token.rlike(STOP)


def ends(df: DataFrame, text: str, source: str, *also: str) -> DataFrame:
    """Rows that are not blank with ``src``, the hashes and length that tell texts apart, ``body`` (the text without what systems put behind it) and the features of its end."""
    t = F.col("__t")
    rows = df.select(*[F.col(c) for c in also], F.col(text).alias("__t"), source_key(F.col(source)).alias("src")).filter(t.isNotNull()).withColumn("trimmed", _trimmed(t)).filter(F.col("trimmed") != "")
    trimmed = F.col("trimmed")
    last = F.right(trimmed, F.lit(1))
    marked = last.isin("…", "�") | trimmed.endswith("...") | (last.isin("]", ")") & F.right(trimmed, F.lit(MARK)).rlike(CLIPPED))
    rows = rows.withColumn("body", F.when(~marked & last.rlike(FOOTER_END), _trimmed(F.regexp_replace(trimmed, FOOTER, ""))).otherwise(trimmed)).filter(F.col("body") != "")
    b = F.col("body")
    last_line = F.substring_index(b, "\n", -1)
    lines = F.split(F.substring_index(b, "\n", -3), "\n")
    above = F.get(lines, F.size(lines) - 2)
    above = F.when(F.trim(above, F.lit(BLANKS)) != "", above).otherwise(F.get(lines, F.size(lines) - 3))  # past one blank line
    lone = F.length(last_line) == F.length(b)
    first_word = lambda line: F.regexp_extract(line, r"^\s*+(\S+)", 1)
    tail = F.right(b, F.lit(MARK))
    inner = F.rtrim(tail, F.lit(CLOSERS))
    end = F.right(b, F.lit(1))
    return rows.select(
        *also, "src", F.xxhash64("__t").alias("h1"), F.xxhash64(F.lit(1), "__t").alias("h2"), F.length("__t").alias("n"), "body",
        (end.isin("…", "�") | b.endswith("...") | (end.isin("]", ")") & tail.rlike(CLIPPED))).alias("clipped"),
        F.right(F.when(inner == "", F.rtrim(b, F.lit(CLOSERS))).otherwise(inner), F.lit(1)).isin(*STOPS).alias("stopped"),
        F.when(t.endswith("\n") | (t.endswith("\x00") & F.rtrim(t, F.lit("\x00")).endswith("\n")), "line").otherwise(F.when(end.isin("}", "]", ">"), end).otherwise("")).alias("last_char"),
        F.when(lone, "").otherwise(first_word(last_line)).alias("last_word"),
        F.when(lone, "").otherwise(F.coalesce(first_word(above), F.lit(""))).alias("before_word"),
        (F.substring(b, 1, 1).isin("{", "[") & (F.length(F.translate(b, "{[", "")) != F.length(F.translate(b, "}]", "")))).alias("unbalanced"),
    )


def _bare(body: Column, clipped: Column) -> Column:
    """The body without its mark of clipping."""
    tail = F.right(body, F.lit(MARK))
    return F.when(clipped, F.concat(F.substring(body, F.lit(1), F.length(body) - F.length(tail)), F.regexp_replace(tail, CLIPPED, ""))).otherwise(body)


def distinct_ends(df: DataFrame, text: str, source: str) -> DataFrame:
    """One row of features per source and distinct text, with its copies and, for texts that may be open, the last two tokens."""
    rows = ends(df, text, source)
    b = F.col("body")
    part = tokens_of(F.right(b, F.lit(WINDOW)))
    rows = rows.withColumn("__w", F.when(~F.col("stopped") & ~F.col("clipped"), part))
    # the first token of the part may be torn, the last two of three or more are whole
    rows = rows.withColumn("__w", F.when((F.size("__w") < 3) & (F.length(b) > WINDOW), tokens_of(b)).otherwise(F.col("__w")))
    k = F.size("__w")
    rows = rows.withColumns({
        "a": F.when(k > 1, F.get("__w", k - 2)).when(k == 1, F.lit("")), "b": F.when(k > 0, F.get("__w", k - 1)),
        "phrase": (F.col("n") <= PHRASE) & F.coalesce(~F.exists("__w", _is_stop), F.lit(False)),
    })
    rows = rows.withColumn("context", F.when(F.col("phrase") & (k > 1), F.xxhash64(F.slice("__w", F.greatest(k - CONTEXT, F.lit(1)), F.least(k - 1, F.lit(CONTEXT))))))
    # the features follow from the text, so that grouping by them too changes nothing and keeps the aggregation by hash
    return rows.withColumn("long", k > CONTEXT).groupBy(*[c for c in (*rows.columns, "long") if c not in ("body", "__w")]).agg(F.count("*").alias("copies"))


def candidate_forms(t: DataFrame) -> DataFrame:
    """src, form, value: what a good part of a source's texts share at their end; a few rows per source."""
    total = t.filter(F.col("src").isNotNull()).groupBy("src").agg(F.count("*").alias("all"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("value")) for f in FORMS])).alias("e")
    shared = t.filter(F.col("src").isNotNull()).select("src", each).select("src", "e.form", "e.value").filter(F.col("value") != "").groupBy("src", "form", "value").agg(F.count("*").alias("has"))
    return shared.join(total, "src").filter((F.col("has") >= CLOSING_SHARE * F.col("all")) & (F.col("has") >= LEAST_TEXTS))


def _wide_forms(forms: DataFrame) -> DataFrame:
    return forms.groupBy(F.col("src").alias("__fs")).agg(*[F.max(F.when(F.col("form") == f, F.col("value"))).alias(f"needs_{f}") for f in FORMS])


def limits(t: DataFrame) -> DataFrame:
    """src, n: lengths that pile up, against the source's texts of nearly that length, among texts without a stop."""
    per = t.groupBy("src", "n").agg(F.count("*").alias("here"), F.sum((~F.col("stopped")).cast("int")).alias("open"))
    near = Window.partitionBy("src").orderBy("n").rangeBetween(-20, 20)  # one row per length
    per = per.withColumn("around", F.sum("here").over(near) - F.col("here"))
    return per.filter((F.col("open") >= 3) & (F.col("open") * 20 > F.col("around"))).select("src", "n")


def repeated_phrases(t: DataFrame) -> DataFrame:
    """h1, h2, n, context, b of phrases with many copies over all sources; REPEATED rows at most, by arithmetic."""
    rows = t.agg(F.sum("copies")).scalar()
    per = t.filter("phrase").groupBy("h1", "h2", "n").agg(F.sum("copies").alias("copies"), F.first("context").alias("context"), F.first("b").alias("b"), F.first("long").alias("long"))
    return per.filter((F.col("copies") >= LEAST_COPIES) & (F.col("copies") * REPEATED >= rows))


def pair_counts(df: DataFrame, text: str, source: str, phrases: DataFrame) -> DataFrame:
    """(a, b, met, goes_on, stops, ends): pairs of tokens in a row over the distinct texts, by what follows.

    ``met`` is the context before ``b`` where that is the context of a repeated phrase.
    """
    rows = ends(df, text, source).select("body", "clipped").groupBy("body", "clipped").agg(F.count("*").alias("__c"))
    t = rows.select(tokens_of(_bare(F.col("body"), F.col("clipped"))).alias("t"))  # no filter by size here: it would cut every text into tokens twice
    pad = lambda n: F.array_repeat(F.lit(""), n)
    # arrays shifted against each other: places before the text are empty, the place behind it is null
    step = F.arrays_zip(F.concat(pad(3), "t").alias("a3"), F.concat(pad(2), "t").alias("a2"), F.concat(pad(1), "t").alias("a"), F.col("t").alias("b"), F.expr("slice(t, 2, size(t))").alias("next"))
    s = t.select(F.explode(step).alias("s")).select("s.*").filter(F.col("b").isNotNull() & ~_is_stop(F.col("b")))
    context = F.when(F.col("a") == "", None).when(F.col("a2") == "", F.xxhash64(F.array("a"))).when(F.col("a3") == "", F.xxhash64(F.array("a2", "a"))).otherwise(F.xxhash64(F.array("a3", "a2", "a")))
    s = s.select("a", "b", context.alias("c"), F.when(F.col("next").isNull(), 2).when(_is_stop(F.col("next")), 1).otherwise(0).alias("x"))
    known = phrases.filter(F.col("context").isNotNull()).select(F.col("context").alias("met")).distinct()
    s = s.join(F.broadcast(known), F.col("c") == F.col("met"), "left")  # REPEATED rows at most
    return s.groupBy("a", "b", "met").agg(F.count_if(F.col("x") == 0).alias("goes_on"), F.count_if(F.col("x") == 1).alias("stops"), F.count_if(F.col("x") == 2).alias("ends"))


def continued(phrases: DataFrame, per: DataFrame) -> DataFrame:
    """h1, h2, n of repeated phrases whose last tokens go on, or end in a longer word, elsewhere among the distinct texts."""
    p = phrases.filter(F.col("context").isNotNull()).select("h1", "h2", "n", "context", F.col("b").alias("__b"), "long")
    met = per.filter(F.col("met").isNotNull()).join(F.broadcast(p), (F.col("met") == F.col("context")) & F.col("b").startswith(F.col("__b")))
    same = F.col("b") == F.col("__b")
    got = met.groupBy("h1", "h2", "n", "long").agg(
        F.sum(F.when(~same, F.col("goes_on") + F.col("stops") + F.col("ends")).otherwise(0)).alias("longer"), F.sum(F.when(same, F.col("goes_on")).otherwise(0)).alias("on"),
        F.sum(F.when(same, F.col("stops") + F.col("ends")).otherwise(0)).alias("over"),
    )
    # a short phrase may well be the beginning of a sentence: words that follow count from a whole context on
    return got.filter((F.col("longer") > 0) | ((F.col("on") > F.col("over")) & F.col("long"))).select("h1", "h2", "n")


def find_cut(df: DataFrame, text: str, source: str) -> DataFrame:
    """(src, h1, h2, n, copies, reason, cut) of distinct texts that are not blank."""
    t = cut_lineage(distinct_ends(df, text, source))
    phrases = cut_lineage(repeated_phrases(t))
    per = cut_lineage(pair_counts(df, text, source, phrases))
    words = per.groupBy("b").agg(F.sum("goes_on").alias("w_on"), F.sum("stops").alias("w_stop"))
    known = words.filter((F.col("w_on") + F.col("w_stop") > 0) & F.col("b").rlike(r"^[\p{L}\p{M}'’\-]{2,}$"))
    # usual ends of a source: tokens that a good part of its texts end with
    finals = t.filter(F.col("b").isNotNull()).groupBy("src", "b").agg(F.count("*").alias("f"))
    usual = finals.join(t.groupBy("src").agg(F.count("*").alias("all")), "src").filter((F.col("f") >= 3) & (F.col("f") >= USUAL_END * F.col("all"))).select(F.col("src").alias("__us"), F.col("b").alias("__ub"), F.lit(True).alias("usual_end"))
    forms = cut_lineage(candidate_forms(t))
    needs, lim = _wide_forms(forms), limits(t)
    u = t.join(needs, F.col("src") == F.col("__fs"), "left").drop("__fs").join(usual, (F.col("src") == F.col("__us")) & (F.col("b") == F.col("__ub")), "left").drop("__us", "__ub")
    lacks = lambda f: F.col(f"needs_{f}").isNotNull() & (F.col(f"needs_{f}") != F.col(f))
    lacking = lacks("last_char") | lacks("last_word") | lacks("before_word")
    formed = F.col("needs_last_char").isNotNull() | F.col("needs_last_word").isNotNull() | F.col("needs_before_word").isNotNull()
    open_end = ~F.col("stopped") & ~F.col("clipped") & (lacking | (F.col("needs_last_char").isNull() & F.col("usual_end").isNull()) | ~formed)
    settled = u.filter(~open_end)
    # only open texts, which have no hot final stop, meet the vocabulary: one row per distinct pair of last tokens
    undecided = u.filter(open_end)
    at = undecided.filter(F.col("b").isNotNull()).select("a", "b").distinct()
    pairs = per.join(at.withColumnsRenamed({"a": "__pa", "b": "__pb"}), (F.col("a") == F.col("__pa")) & (F.col("b") == F.col("__pb"))).groupBy("__pa", "__pb").agg(F.sum("goes_on").alias("goes_on"), F.sum("stops").alias("stops"))
    nodes = known.select(F.explode(F.expr("transform(sequence(1, length(b) - 1), i -> substring(b, 1, i))")).alias("node")).groupBy("node").agg(F.count("*").alias("below"))
    last = at.select("b").distinct().join(nodes, F.col("b") == F.col("node"), "left").drop("node").join(words.select(F.col("b").alias("__wb"), "w_on", "w_stop"), F.col("b") == F.col("__wb"), "left").drop("__wb")
    at = at.join(last.withColumnRenamed("b", "__lb"), F.col("b") == F.col("__lb")).drop("__lb").join(pairs, (F.col("a") == F.col("__pa")) & (F.col("b") == F.col("__pb")), "left").drop("__pa", "__pb")
    judged = undecided.join(at.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "below", "w_on", "w_stop", "goes_on", "stops"), (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left").drop("__a", "__b")
    judged = judged.join(lim.select(F.col("src").alias("__ms"), F.col("n").alias("__mn"), F.lit(True).alias("at_limit")), F.col("src").eqNullSafe(F.col("__ms")) & (F.col("n") == F.col("__mn")), "left").drop("__ms", "__mn")
    go = continued(phrases, per).select(F.col("h1").alias("__g1"), F.col("h2").alias("__g2"), F.col("n").alias("__gn"), F.lit(True).alias("continued"))
    many = phrases.select(F.col("h1").alias("__r1"), F.col("h2").alias("__r2"), F.col("n").alias("__rn"), F.lit(True).alias("repeated"))
    many = many.join(go, (F.col("__r1") == F.col("__g1")) & (F.col("__r2") == F.col("__g2")) & (F.col("__rn") == F.col("__gn")), "left").drop("__g1", "__g2", "__gn")
    judged = judged.join(F.broadcast(many), (F.col("h1") == F.col("__r1")) & (F.col("h2") == F.col("__r2")) & (F.col("n") == F.col("__rn")), "left").drop("__r1", "__r2", "__rn")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    unknown = (zero("w_on") + zero("w_stop") == 0) & (zero("below") > 0)
    own = (
        F.when(no("repeated") & ~no("continued"), None)
        .when(unknown, "prefix")
        .when(no("at_limit"), "limit")
        .when(zero("goes_on") > zero("stops"), "goes on")
        .when(no("continued"), "goes on")
        .when((zero("stops") > 0) | F.col("phrase"), None)
        .otherwise("open end")
    )
    judged = cut_lineage(judged.withColumn("own", own))
    both = judged.unionByName(settled.withColumn("own", F.when(F.col("clipped"), "clipped")), allowMissingColumns=True)
    # a form holds where the texts without it mostly carry evidence of their own
    each = F.explode(F.array(*[F.when(lacks(f), F.lit(f)) for f in FORMS])).alias("form")
    without = both.filter(lacking).select("src", each, F.col("own").isNotNull().alias("e")).filter(F.col("form").isNotNull()).groupBy("src", "form").agg(F.avg(F.col("e").cast("double")).alias("evident"))
    bad = without.filter(F.col("evident") < LACKING).select("src", "form")
    held = _wide_forms(forms.join(bad, ["src", "form"], "left_anti"))
    final = both.drop(*[f"needs_{f}" for f in FORMS]).join(held, F.col("src") == F.col("__fs"), "left").drop("__fs")
    reason = (
        F.when(F.col("clipped"), "clipped")
        .when(lacking | (formed & F.col("unbalanced")), "no closing")
        .when(F.col("needs_last_char").isNotNull(), None)
        .when(formed & F.col("usual_end").isNotNull(), None)
        .when(formed, F.when(F.col("own").isin("prefix", "goes on"), F.col("own")))
        .otherwise(F.col("own"))
    )
    return final.select("src", "h1", "h2", "n", "copies", reason.alias("reason")).withColumn("cut", F.col("reason").isNotNull())


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, src, reason) of every record whose text is cut."""
    cut = find_cut(df, text, source).filter("cut").select(F.col("src").alias("__s"), F.col("h1").alias("__1"), F.col("h2").alias("__2"), F.col("n").alias("__n"), "reason")
    t = F.col(text)
    rows = df.filter(t.isNotNull()).select(F.col(key).alias(key), source_key(F.col(source)).alias("src"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), F.length(t).alias("n"))
    hit = rows.join(cut, (F.col("h1") == F.col("__1")) & (F.col("h2") == F.col("__2")) & (F.col("n") == F.col("__n")) & F.col("src").eqNullSafe(F.col("__s")))
    return hit.select(key, "src", "reason")


def report(df: DataFrame, text: str, source: str) -> DataFrame:
    """src, texts (all records of the source, null and blank ones included), cut, share."""
    t = find_cut(df, text, source).filter("cut").groupBy(F.col("src").alias("__s")).agg(F.sum("copies").alias("cut"))
    per = df.groupBy(source_key(F.col(source)).alias("src")).agg(F.count("*").alias("texts")).join(t, F.col("src").eqNullSafe(F.col("__s")), "left")
    return per.select("src", "texts", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"))
