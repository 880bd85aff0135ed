"""Faceted search over collectibles: dimensions, counts, pages, intersections and attribute projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordinals, page


def facet_values(immutable: Column, mutable: Column, field: str) -> Column:
    """The value of a facet: the immutable one first; only 1 to 64 bytes count."""
    value = F.coalesce(F.try_element_at(immutable, F.lit(field)), F.try_element_at(mutable, F.lit(field)))
    return F.when(F.octet_length(value).between(1, 64), value)


def dimensions(assets: DataFrame, fields: list[str], id_: str = "asset_id") -> DataFrame:
    """(dim, key, id) rows: owner, collection, schema, template and every facet; a facet's key holds collection and schema."""
    parts = [F.struct(F.lit(d).alias("dim"), F.col(c).cast("string").alias("key")) for d, c in (("owner", "owner"), ("collection", "collection_name"), ("template", "template_id"))]
    parts.append(F.struct(F.lit("schema").alias("dim"), F.concat_ws("/", "collection_name", "schema_name").alias("key")))
    for f in fields:
        v = facet_values(F.col("immutable_data"), F.col("mutable_data"), f)
        parts.append(F.struct(F.lit("facet").alias("dim"), F.when(v.isNotNull(), F.concat_ws("/", "collection_name", "schema_name", F.lit(f), v)).alias("key")))
    return assets.select(F.explode(F.array(*parts)).alias("x"), F.col(id_)).filter("x.key is not null").select("x.dim", "x.key", id_)


def counts(dims: DataFrame) -> DataFrame:
    return dims.groupBy("dim", "key").agg(F.count("*").alias("n"))


def dim_page(dims: DataFrame, dim: str, key: str, n: int, after=None, id_: str = "asset_id") -> DataFrame:
    return page(dims.filter((F.col("dim") == dim) & (F.col("key") == key)), id_, n, after)


def intersect(dims: DataFrame, wanted: list[tuple[str, str]], id_: str = "asset_id") -> DataFrame:
    """Ids that stand under all the keys: semi-joins from the first, so only ids move."""
    sets = [dims.filter((F.col("dim") == d) & (F.col("key") == k)).select(id_) for d, k in wanted]
    return reduce(lambda a, b: a.join(b, id_, "left_semi"), sets)


def with_mint(assets: DataFrame, id_: str = "asset_id") -> DataFrame:
    """1-based rank of an asset among those of its template; 0 without one."""
    ranked = ordinals(assets.filter("template_id is not null"), ["contract", "template_id"], [id_], "template_mint")
    return ranked.unionByName(assets.filter("template_id is null").withColumn("template_mint", F.lit(0)))


def known_attributes(data: Column, format_: Column) -> Column:
    """Only attributes that the schema lists."""
    return F.map_filter(data, lambda k, _: F.array_contains(F.transform(format_, lambda f: f["name"]), k))


def hydrate(ids: DataFrame, assets: DataFrame, templates: DataFrame, id_: str = "asset_id") -> DataFrame:
    """Assets of a page with the immutable data of their template, newest first."""
    t = templates.select("contract", "template_id", F.col("immutable_data").alias("template_data"))
    return ids.select(id_).join(assets, id_).join(t, ["contract", "template_id"], "left").orderBy(F.col(id_).desc())
