"""Makes this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker, and rows that a Parquet reader holds as arrays,
#: where the session hasn't said otherwise than Spark does. Buffers for several batches stand on both
#: sides of every running task, and grow by doubling; texts make large arrays of a few rows.
BATCH_BYTES, READ_ROWS = 1 << 20, 512
_LIMITS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": (f"{64 << 20}b", f"{BATCH_BYTES}b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", str(READ_ROWS)),
}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each application."""
    sc = spark.sparkContext
    for name, (sparks, ours) in _LIMITS.items():
        if spark.conf.get(name, sparks) == sparks:
            spark.conf.set(name, ours)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # The driver serves the archive for as long as the application runs.
    place = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    archive = os.path.join(place, f"{root.name}_sources.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def _tidy(function):
    """``function``, giving memory back to the system when its task ends: workers live on."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers, for columns of any name."""
    ship(df.sparkSession)
    function = _tidy(function)
    names = df.columns
    if not any(set(c) & set(".`") for c in names):
        return df.mapInArrow(function, schema)
    # mapInArrow takes dots for fields of structs, so the columns go by number meanwhile.
    import pyarrow as pa

    plain = [f"c{i}" for i in range(len(names))]
    out = list(schema.names) if isinstance(schema, StructType) else None
    inner = StructType([StructField(f"r{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)]) if out else schema

    def renamed(batches):
        for b in function(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=[f"r{i}" for i in range(len(out))]) if out else b

    found = df.toDF(*plain).mapInArrow(renamed, inner)
    return found.toDF(*out) if out else found
