"""Shared storage, lineage cuts and Arrow helpers used by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir, or an own one where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has already ended
        pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_chars: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one come to about max_chars bytes; a longer single row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > max_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def arrow_columns(df: DataFrame, inputs: list[str], added: str, rows: Callable[..., tuple]) -> DataFrame:
    """df with the columns of the DDL string added (or replaced), computed row by row in Python from the inputs.

    One Arrow stage of its own: all other columns pass through untouched, and the optimiser can't copy the work elsewhere.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [rows(*r) for r in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
            columns = list(zip(*results, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*(f.name for f in kept), *new.names])

    return df.mapInArrow(run, T.StructType(kept + new.fields))
