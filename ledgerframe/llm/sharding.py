"""Sharding by extendible hashing.

A document's key is the first 60 bits of the MD5 of its id and text. The directory is a binary trie over key
prefixes: a bucket whose bytes exceed the limit splits on its next bit, all others stay as they are, so a shard is
the shallowest prefix that fits. Byte counts are aggregated per prefix cell before anything is decided, and only the
cells that are still too large are looked at with more bits, so no pass depends on a single group of documents.

Defined results: a null text counts as empty and weighs no bytes; a null id has a key of its own text; a document
larger than the limit is alone in its shard; rows with equal id and text share all key bits, and where they exceed the
limit together they are dealt to numbered overflow pages; an empty table gives an empty result; input columns named
like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import put, text_or_empty
from .storage import materialize

KEY_BITS = 60
SHARD_BYTES = 64 << 20
#: The limit of the query, at which small tables split too.
QUERY_BYTES = 1 << 20
_STEP = 10


def key_bits() -> Column:
    """60 key bits of ``doc_id`` and ``text`` as a non-negative long."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit(":"), text_or_empty())
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, KEY_BITS - depth)


def directory(sizes: DataFrame, limit: int, step: int = _STEP) -> list[tuple[int, DataFrame]]:
    """For ``sizes(key, bytes)``: pairs of a number of bits g and a table (cell, depth, shard_bytes, shard_docs) that
    gives the depth of the shard of every resolved g-bit cell. Each later pair covers only cells left by the former."""
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits, done, levels = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4), 0, []
    rest = sizes
    while True:
        cells = rest.groupBy(_prefix(F.col("key"), bits).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        chain = materialize(cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)")), "cells")
        fits = chain.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == KEY_BITS))
        leaf = chain.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("x")).select("cell", "x.*")
        leaf = materialize(leaf, "directory")
        levels.append((bits, leaf))
        left = materialize(chain.select("cell").distinct().join(leaf, "cell", "left_anti"), "oversized")
        if bits == KEY_BITS or left.isEmpty():
            return levels
        # only documents of buckets that are still too large go on, with more bits
        rest = rest.withColumn("cell", _prefix(F.col("key"), bits)).join(left, "cell", "left_semi").select("key", "bytes")
        done, bits = bits + 1, min(KEY_BITS, bits + step)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, step: int = _STEP) -> DataFrame:
    """``docs`` with shard_id (the bits of the prefix, ``*`` for the whole), local_depth, overflow_page, shard_bytes and
    shard_docs. All copies of an overflowing key share one prefix; their pages hold at most ``limit`` bytes each."""
    if limit < 1:
        raise ValueError("the byte limit must be positive")
    levels = directory(docs.select(key_bits().alias("key"), F.octet_length(text_or_empty()).cast("long").alias("bytes")), limit, step)
    out = put(docs, _key=key_bits(), _depth=F.lit(None).cast("int"), _bytes=F.lit(None).cast("long"), _docs=F.lit(None).cast("long"))
    for bits, leaf in levels:
        leaf = leaf.select(F.col("cell").alias("_cell"), *(F.col(c).alias(f"_{c}2") for c in ("depth", "shard_bytes", "shard_docs")))
        out = out.withColumn("_at", _prefix(F.col("_key"), bits)).join(leaf, F.col("_at") == F.col("_cell"), "left")
        out = out.withColumns({"_depth": F.coalesce("_depth", "_depth2"), "_bytes": F.coalesce("_bytes", "_shard_bytes2"), "_docs": F.coalesce("_docs", "_shard_docs2")}).drop("_at", "_cell", "_depth2", "_shard_bytes2", "_shard_docs2")
    crowded = levels[-1][0] == KEY_BITS and not levels[-1][1].filter((F.col("depth") == KEY_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).isEmpty()
    page = F.lit(0).cast("long")
    if crowded:
        out, page = _numbered(out, limit), F.coalesce("_page", F.lit(0).cast("long"))
    name = F.when(F.col("_depth") == 0, "*").otherwise(F.expr(f"lpad(bin(shiftright(_key, {KEY_BITS} - _depth)), _depth, '0')"))
    return put(out, shard_id=name, local_depth=F.col("_depth"), overflow_page=page, shard_bytes=F.col("_bytes"), shard_docs=F.col("_docs")).drop("_key", "_depth", "_bytes", "_docs", "_page")


def _numbered(out: DataFrame, limit: int) -> DataFrame:
    """Pages of keys whose rows cannot be told apart: equal rows are numbered within each stored part and shifted by
    the counts of earlier parts, so that no task orders a whole group."""
    from pyspark.sql import Window

    at = (F.col("_depth") == KEY_BITS) & (F.col("_bytes") > limit) & (F.col("_docs") > 1)
    stored = materialize(out.withColumn("_over", at), "overflow").withColumns({"_part": F.when(F.col("_over"), F.spark_partition_id()), "_mono": F.monotonically_increasing_id()})
    plain, over = stored.filter(~F.col("_over")), stored.filter("_over")
    counts = over.groupBy("_key", "_part").count().withColumn("_shift", F.sum("count").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_mono"))
    over = over.withColumn("_no", number).join(counts.select("_key", "_part", "_shift"), ["_key", "_part"])
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.expr("_bytes div _docs"))))
    over = over.withColumn("_page", F.floor((F.col("_no") - 1 + F.coalesce("_shift", F.lit(0))) / per))
    plain = plain.withColumn("_page", F.lit(0).cast("long"))
    columns = [*out.columns, "_page"]
    return plain.select(columns).unionByName(over.select(columns))


def op1_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, QUERY_BYTES).select("doc_id", "shard_id", "local_depth", "overflow_page", "shard_bytes", "shard_docs")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes
  FROM documents),
p AS (SELECT depth, h >> ({KEY_BITS} - depth) AS prefix, sum(bytes) AS b, count(*) AS n
      FROM d, generate_series(0, 30) g(depth) GROUP BY 1, 2),
leaf AS (
  SELECT d.doc_id, d.h, min(depth) AS depth
  FROM d, p WHERE p.prefix = d.h >> ({KEY_BITS} - depth) AND (b <= {QUERY_BYTES} OR n = 1) GROUP BY ALL)
SELECT doc_id, CASE WHEN l.depth = 0 THEN '*' ELSE lpad(bin(p.prefix), l.depth::INTEGER, '0') END AS shard_id,
       l.depth::INTEGER AS local_depth, 0::BIGINT AS overflow_page, b::BIGINT AS shard_bytes, n::BIGINT AS shard_docs
FROM leaf l JOIN p ON p.depth = l.depth AND p.prefix = l.h >> ({KEY_BITS} - l.depth)
"""
