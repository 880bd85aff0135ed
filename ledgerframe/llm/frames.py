"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


_shipped: set[str] = set()


def ship(sc: SparkContext) -> None:
    """Sends this package to the Python workers, once for each application; they may not have it on their path."""
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="ledgerframe-")) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession.sparkContext)
    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def put(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with result columns at the end; an input column of the same name is replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in columns]
    return docs.select(*kept, *[v.alias(k) for k, v in columns.items()])


def shielded(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply`` for filters that return the columns of ``docs``: all but the key columns pass under other names, so that
    no result column of the operator takes the place of one of them."""
    away = {c: f"_in_{c}" for c in docs.columns if c not in ("doc_id", "text", "source", "lang")}
    out = apply(docs.withColumnsRenamed(away))
    return out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def add_by_arrow(docs: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without ``drop`` and with ``fields``, computed batch by batch in Python workers.

    Input columns named like a field are replaced.
    """
    names = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(T.StructType(fields))
    positions = [docs.schema.names.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [a if a.type == f.type else a.cast(f.type) for a, f in zip(compute(batch), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in positions], *made], names=schema.names)

    return map_arrow(docs, run, schema)
