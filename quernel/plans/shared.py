"""Tables in the shared folder, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(), "quernel_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, as in tests, a local session gets a temporary one of its own; a cluster
    session gets an error, since its executors would not see a local folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quernel.shared.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='quernel-')}"
        spark.conf.set("quernel.shared.dir", top)
    return f"{top.rstrip('/')}/quernel/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df written once to the shared folder: later steps re-read them instead of
    computing them again, and a lost executor loses none of them."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
