"""Session construction and the few session-level settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "quire", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings this library is tuned for.

    On a cluster, pass ``master=None`` and let spark-submit decide; the shuffle
    partition count then comes from the cluster config (AQE coalesces small ones).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is.  Only a local-mode session without one (tests, laptops) gets a fresh
    scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    path = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


# Names of the bucketed tables by the checkpoint folder that holds them.
_BUCKETED: dict[str, list[str]] = {}


def _stored_path(spark: SparkSession) -> tuple[str, str]:
    name = uuid.uuid4().hex
    return name, ensure_checkpoint_dir(spark).rstrip("/") + f"/quire-tables/{name}"


def stored_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, removed with the stored tables."""
    return _stored_path(spark)[1]


def cut_lineage(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from the
    stored copy (survives executor loss; lineage stops here).

    The rows are written as parquet under the checkpoint folder and read back:
    one job, output partitions sized by adaptive execution, and the copy gets
    column pruning, filter pushdown and (with ``partition_by``) partition pruning."""
    spark = df.sparkSession
    _, path = _stored_path(spark)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.parquet(path) if not partition_by else spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, n: int, key: list[str], partition_by: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Materialise ``df`` as a table in the checkpoint folder, hash-bucketed on
    ``key`` into ``n`` buckets: joins and aggregations on the key need no
    shuffle, scans are pruned as usual, and adaptive execution stays on.
    ``dealt``: the rows lie in ``n`` partitions by ``key`` already, which Spark doesn't see behind a Python function."""
    spark = df.sparkSession
    name, path = _stored_path(spark)
    rows = df if dealt else df.repartition(n, *key)
    w = rows.write.format("parquet").option("compression", "zstd").bucketBy(n, *key).option("path", path)
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(f"quire_{name}")
    _BUCKETED.setdefault(ensure_checkpoint_dir(spark), []).append(f"quire_{name}")
    return spark.table(f"quire_{name}")


def drop_stored(spark: SparkSession) -> None:
    """Remove the tables that ``cut_lineage`` and ``store_bucketed`` left in this application's own
    checkpoint folder.  For the end of a job: frames read from them are gone afterwards."""
    folder = ensure_checkpoint_dir(spark)
    for name in _BUCKETED.pop(folder, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/quire-tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
