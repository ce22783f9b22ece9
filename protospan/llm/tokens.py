"""Encoding a corpus with a public byte-level BPE, each distinct pre-token once.

Texts are cut into pre-tokens by the vocabulary's pattern (in the JVM), exploded with positions, reduced to
distinct pre-tokens, encoded once each by the merge ranks, joined back and put together by position. Decoding
joins the table of token bytes.

Scale: distinct pre-tokens combine map-side. Those that make up 1 / ``HOT`` of all or more (so at most ``HOT`` rows,
of ``HOT_LENGTH`` characters) go to every task as a table of proven size; a shuffled key holds under 1 / ``HOT`` of
the rows, less than a partition's share up to ``HOT`` partitions (a pre-token longer than that may be hotter; its rows
are few, being long). Each id travels as one number that also holds its place, and a document's numbers combine
map-side. The rank file (checked against ``MOST_RANK_BYTES``) is read once by the driver and sent to the workers.

Defined results: null and empty texts give an empty list; text that looks like a special token is plain text;
every row keeps its own result even where ids or texts repeat; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: how the public byte-level vocabularies split text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the same split in the JVM: blanks by Unicode; plain words and numbers first, where no other alternative could match earlier
PRE_TOKEN = "(?U) ?[a-zA-Z]++(?!\\p{IsL})| ?[0-9]++(?!\\p{IsN})|" + PATTERN.replace(r"\p{L}", r"\p{IsL}").replace(r"\p{N}", r"\p{IsN}")
VOCABULARY = "byte_bpe_50k"
HOT, HOT_LENGTH = 20_000, 128  # hot pre-tokens make up 1 / HOT of all; the broadcast has HOT rows of HOT_LENGTH characters at most
ID_BITS, PART_BITS = 20, 12
MOST_IDS = 1 << PART_BITS
MOST_RANK_BYTES = 1 << 27
ENCODED = "word string, ids array<int>"


def rank_file(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Place of a rank file: ``folder``, else ``$TOKENIZERS_DIR``, else the installed package of public tokenizers."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if folder is None:
        try:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.path(name))
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, f"{name}.tiktoken")


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _load(path: str) -> bytes:
    if os.path.getsize(path) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than a rank file may be")
    with open(path, "rb") as f:
        return f.read()


def pre_tokens(text) -> "F.Column":
    """The pre-tokens of a text in order; blanks by Unicode. Plain words and numbers, which most are, are tried first."""
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct pre-tokens."""
    sent = words.sparkSession.sparkContext.broadcast(_load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(sent.value), special_tokens={})
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, ENCODED)


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row. Equal texts under one key bring each position as often as they repeat, and are told apart by that."""
    path = path or rank_file()
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    blank = rows.filter(F.col("__t").isNull() | (F.col("__t") == "")).select(F.col("__k").alias(key), F.array().cast("array<int>").alias("ids"))
    full = rows.filter(F.col("__t").isNotNull() & (F.col("__t") != ""))
    places = full.select("__k", F.xxhash64("__t").alias("__h"), F.posexplode(pre_tokens(F.col("__t"))).alias("pos", "word"))
    counts = full.select(F.explode(pre_tokens(F.col("__t"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.max(F.length("word")).alias("len"))  # a filter by length here would keep the count from being shared
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("len") > 0, F.col("n"))), F.lit(0)).alias("n")).scalar()  # every pre-token has a length; reading it keeps the count one and the same plan
    is_hot = (F.col("n") * HOT >= total) & (F.col("len") <= HOT_LENGTH)  # at most HOT rows, since their counts sum to the total at most
    hot = encode_words(counts.filter(is_hot), path).select(F.col("word").alias("hot_word"), F.col("ids").alias("hot_ids"))
    coded = encode_words(counts.filter(~is_hot), path)
    marked = places.join(F.broadcast(hot), F.col("word") == F.col("hot_word"), "left")
    done = marked.filter(F.col("hot_ids").isNotNull()).select("__k", "__h", "pos", F.col("hot_ids").alias("ids"))
    rare = marked.filter(F.col("hot_ids").isNull()).select("__k", "__h", "pos", "word").join(coded.hint("shuffle_hash"), "word").select("__k", "__h", "pos", "ids")
    # a number per id: place of the word, place in the word, id. Most words have one id; those of several become numbers
    # after the shuffle, and a word of very many ids keeps its list
    place = F.shiftleft(F.col("pos").cast("long"), ID_BITS + PART_BITS)
    k = F.size("ids")
    every = done.unionByName(rare).select(
        "__k", "__h", F.when(k == 1, place.bitwiseOR(F.get("ids", F.lit(0)).cast("long"))).alias("code"), (F.col("pos") == 0).cast("int").alias("first"),
        F.when((k > 1) & (k <= MOST_IDS), F.struct("pos", "ids")).alias("more"), F.when(k > MOST_IDS, F.struct("pos", "ids")).alias("long"),
    )
    parts = every.groupBy("__k", "__h").agg(F.collect_list("code").alias("__c"), F.collect_list("more").alias("__m"), F.collect_list("long").alias("__l"), F.sum("first").alias("__n"))
    number = lambda p, x, i: F.shiftleft(F.shiftleft(p["pos"].cast("long"), PART_BITS).bitwiseOR(i.cast("long")), ID_BITS).bitwiseOR(x.cast("long"))
    parts = parts.withColumn("__c", F.sort_array(F.concat("__c", F.flatten(F.transform("__m", lambda p: F.transform(p["ids"], lambda x, i: number(p, x, i)))))))
    id_of = lambda c: c.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")
    entry = lambda pos, ids, at: F.named_struct(F.lit("pos"), pos, F.lit("at"), at, F.lit("ids"), ids)
    mixed = F.concat(
        F.transform("__c", lambda c: entry(F.shiftrightunsigned(c, ID_BITS + PART_BITS).cast("int"), F.array(id_of(c)), F.shiftrightunsigned(c, ID_BITS))),
        F.transform("__l", lambda p: entry(p["pos"], p["ids"], F.lit(0).cast("long"))),
    )
    n = F.col("__n").cast("int")
    nth = lambda c: F.when(n == 1, c).otherwise(F.filter(c, lambda _, i: i % n == 0))
    ids = F.when(F.size("__l") == 0, F.transform(nth(F.col("__c")), id_of)).otherwise(F.flatten(F.transform(nth(F.array_sort(mixed)), lambda p: p["ids"])))
    out = parts.select(F.col("__k").alias(key), ids.alias("ids"), F.explode(F.array_repeat(F.lit(0), n)).alias("__x")).select(key, "ids")
    return out.unionByName(blank)


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, bytes): what each token stands for; as many rows as the vocabulary has tokens."""
    ranks = _ranks(_load(path or rank_file()))
    table = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks.keys()), pa.binary())})
    return spark.createDataFrame(table)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text) of lists of ids; keys must be unique. An empty list gives an empty text."""
    table = token_bytes(df.sparkSession, path)
    at = df.select(F.col(key).alias("__k"), F.posexplode_outer(F.col(ids)).alias("pos", "__id"))
    got = at.join(table, at["__id"] == table["id"], "left").groupBy("__k").agg(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("h")))).alias("__p"))
    text = F.unhex(F.concat_ws("", F.transform(F.array_sort("__p"), lambda p: p["h"])))
    return got.select(F.col("__k").alias(key), F.decode(text, "UTF-8").alias("text"))
