"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "ferret",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the jobs in this package.

    Local runs (tests, bench) get a ``local[$BENCH_CPUS]`` master, a shuffle width equal
    to the core count and a large driver heap. On a cluster (``SPARK_MASTER`` set or a
    non-local ``master``) sizing comes from spark-submit; only what is unset is filled:
    AQE starts from a wide initial shuffle (``initialPartitionNum``) and coalesces to the
    advisory partition size, so a 100 TB shuffle is not squeezed into a fixed width.
    The UI stays off (no server is opened).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        os.environ["PYTHONPATH"] = root + (os.pathsep + paths if paths else "")
    local = (master or "").startswith("local") or (master is None and not os.environ.get("SPARK_MASTER"))
    builder = SparkSession.builder.appName(app)
    if local:
        builder = (builder.master(master or f"local[{cpus}]")
                   .config("spark.driver.memory", os.environ.get("FERRET_DRIVER_MEMORY", "16g")))
    elif master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    conf = spark.conf
    if shuffle_partitions:
        conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif local:
        conf.set("spark.sql.shuffle.partitions", cpus)
    else:
        if conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None:
            width = spark.sparkContext.defaultParallelism * 8
            conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(width, 4096)))
        if conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB") == "64MB":
            conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256MB")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is used as is. Only when the
    setting is missing on a local master (tests) a fresh scratch folder is made; on a
    cluster that is an error, as executors share no machine-local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ferret-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of this application below the shared checkpoint folder (not created yet)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ferret/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a folder of this application and read from there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a task hands to its Python worker at a time where the rows hold whole texts.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """While a job with an Arrow function over whole texts runs: JVM and worker hold little of them at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before is None:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ferret`` importable in Python workers (the ``--py-files`` mechanism).

    The package is zipped in memory once per SparkContext, written through the Hadoop
    FileSystem API into the shared checkpoint folder (HDFS, object store or local) and
    added with ``addPyFile``, so executors on any node can import it.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import io
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    base = ensure_checkpoint_dir(spark).rstrip("/")
    uri = f"{base}/pyfiles/ferret-{os.getpid()}-{key}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _SHIPPED.add(key)
