"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "signalframe", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; settings given by the cluster stay."""
    builder = SparkSession.builder.appName(app)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local master, as in tests, takes a new folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="signalframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of ``kept`` that nothing lazy reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
