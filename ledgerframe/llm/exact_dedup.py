"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own bytes say so, in every script: after white space that follows one of a few letters, after some of
the bytes that end a non-ASCII character, and after some pairs of letters and digits (for text without white space). So equal
passages give equal chunks wherever they stand. Chunks are made of the UTF-8 bytes, one character for each. Each distinct chunk text crosses the network once, to
verify that its 64-bit hash belongs to no other chunk text; hashes that do not are given numbered identifiers. From then
on a document is the ordered list of its chunk identifiers, and only those short lists are grouped and joined.

Defined results: null text counts as empty; texts are equal only if identical; of equal texts the row with the
largest doc_id stays; rows with equal doc_id and equal text are one document, and all of them are marked kept (the
filter :func:`deduplicate` lets one of them through); a group whose ids are all null keeps the null id; an empty
table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import put, shielded, text_or_empty
from .storage import materialize

#: Lengths of a chunk in bytes, and the places where it may end.
SHORTEST, LONGEST = 256, 4096
ENDS = r"(?<=[dlnt]\s|[\x84\x8D\x96\x9F\xA8\xB1\xBA]|[bgjqvxzBGJQVXZ0369][bgjqvxzBGJQVXZ1478])"
#: Groups of at least this share of all rows are spread by a broadcast of their (at most 1 / share) recipes.
HOT_SHARE = 1 / 256


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The content-defined chunks of a text, in order; joined they are its UTF-8 bytes, each as a character of Latin-1."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(rf"(?s).{{{shortest},{longest}}}?{ENDS}|.{{1,{longest}}}"), F.lit(0))


def ambiguous_chunks(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """Chunk texts whose hash another chunk text has too: (chunk, hash, number), empty but for hash collisions."""
    distinct = docs.select(F.explode(chunks(text_or_empty())).alias("chunk")).select("chunk", hashed(F.col("chunk")).alias("hash")).distinct()
    shared = distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).cast("long")
    return distinct.join(shared, "hash").select("chunk", "hash", number.alias("number"))


def recipes(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` with the column ``_recipe``: the number of chunks, then verified chunk identifiers in order. The identifier of
    a chunk is its hash; texts with a chunk whose hash is shared also list, after all hashes, the places and numbers of such
    chunks."""
    ambiguous = materialize(ambiguous_chunks(docs, hashed), "ambiguous")
    plain = F.transform(chunks(text_or_empty()), lambda c: hashed(c))
    plain = F.concat(F.array(F.size(plain).cast("long")), plain)
    if ambiguous.isEmpty():
        return put(docs, _recipe=plain)
    # rare: texts that hold an ambiguous chunk are numbered chunk by chunk, keyed by the text itself
    tagged = put(docs, _plain=plain, _text=text_or_empty())
    pieces = tagged.select("_text").distinct().select("_text", F.posexplode(chunks(F.col("_text"))).alias("at", "chunk"))
    numbers = pieces.join(ambiguous, "chunk").groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("_numbers"))
    tail = F.flatten(F.transform("_numbers", lambda x: F.array(x["at"].cast("long"), x["number"])))
    out = tagged.join(numbers, "_text", "left")
    return put(out, _recipe=F.concat("_plain", F.coalesce(tail, F.array().cast("array<bigint>")))).drop("_plain", "_text", "_numbers")


def mark_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64, hot_share: float = HOT_SHARE) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256."""
    found = recipes(docs, hashed)
    groups = materialize(found.groupBy("_recipe").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size")), "recipes")
    rows = groups.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    hot = groups.filter(F.col("_size") >= max(1000, rows * hot_share)).select(F.col("_recipe").alias("_hot"), F.col("_keep").alias("_keep1"), F.col("_size").alias("_size1"))
    cold = groups.select(F.xxhash64("_recipe").alias("_at"), F.col("_recipe").alias("_cold"), "_keep", "_size")
    # rows of hot groups need no partner in the second join; they are spread over its partitions
    spread = F.when(F.col("_size1").isNotNull(), F.xxhash64("doc_id", F.lit("spread"))).otherwise(F.xxhash64("_recipe"))
    own = put(found, text_sha256=F.sha2(text_or_empty().cast("binary"), 256))
    out = own.join(F.broadcast(hot), F.col("_recipe") == F.col("_hot"), "left").withColumn("_to", spread)
    out = out.join(cold, (F.col("_to") == F.col("_at")) & (F.col("_recipe") == F.col("_cold")), "left")
    keep = F.when(F.col("_size1").isNotNull(), F.col("_keep1")).otherwise(F.col("_keep"))
    out = out.withColumn("_who", keep).withColumn("_many", F.coalesce("_size1", "_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("_who"))
    return put(out, keep_id=F.col("_who"), group_size=F.col("_many"), kept=kept, text_sha256=F.col("text_sha256")).drop("_recipe", "_hot", "_keep1", "_size1", "_to", "_at", "_cold", "_keep", "_size", "_who", "_many")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts."""
    return shielded(docs, lambda own: mark_duplicates(own).filter("kept").dropDuplicates(["doc_id", "text_sha256"]))


def op2_chunk_recipe_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
