"""Session helper and the one place where lineage is cut."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", name: str = "rhythmlake", **conf: str) -> SparkSession:
    """A local session with the settings that the operators expect (UTC, adaptive execution)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset and the master is local (tests, one machine) it is a folder of this machine; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "rhythmlake-shared")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Used where a result feeds several branches and recomputing it would cost more than its bytes,
    and where rows must not change between two reads. It survives the loss of executors, and is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _package() -> str:
    """This package as a zip file named by its content."""
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{f.relative_to(root).as_posix()}"), f.read_bytes())
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip")
    Path(path).write_bytes(held.getvalue())
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, wherever they run; once a session."""
    path = _package()
    if not any(f.endswith(os.path.basename(path)) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(path)
    return spark
