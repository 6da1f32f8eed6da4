"""Tables in the shared folder of the cluster, used to cut lineage.

``spark.checkpoint.dir`` names a folder that the driver and all executors share. A table written there
survives the loss of any executor, is read back column by column, and keeps real size statistics, so joins
on it are planned from measured sizes. Where the setting is absent (tests on one machine) a temporary folder
is used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of texts that go to a Python worker at a time. Spark's own limit is 64 MB, of which the executor and the worker each hold several copies.
BATCH = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local temporary one only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plinthwork-")
    return _own[app]


def cut(df: DataFrame, label: str, observe=None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage behind the files.

    ``observe`` may be an ``Observation`` with its columns, filled by the same job. The folder is removed
    when the application ends, or earlier by :func:`drop`.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/plinthwork/{spark.sparkContext.applicationId}"
    if root not in _written:
        _written[root] = spark
        atexit.register(_remove, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    if observe is not None:
        observation, *columns = observe
        df = df.observe(observation, *columns)
    df.write.option("compression", "zstd").parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    out = spark.read.schema(schema).parquet(path)
    out._plinth_path = path
    return out


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the Arrow batches of its session to ``BATCH`` bytes; a bound that the session has set stays.

    Spark reads the setting when a plan runs, so it is left on. Batches only deal out rows; no result depends on them.
    """
    if df.sparkSession.conf.get(_ARROW, None) is None:
        df.sparkSession.conf.set(_ARROW, str(BATCH))
    return df


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_plinth_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove(root: str) -> None:
    spark = _written.pop(root, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            _delete(spark, root)
        except Exception:  # the gateway may be gone while the interpreter ends
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever path Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


