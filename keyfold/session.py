"""Session construction and shared-folder handling.

On a cluster the session is given to us; we only read settings from it.  The
shared folder for checkpoints and intermediate tables comes from
``spark.checkpoint.dir``.  Only when that is unset (local tests) do we create a
folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "keyfold",
    event_log_dir: str | None = None,
) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config(
            "spark.eventLog.dir", event_log_dir
        )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        # a folder of our own only where driver and executors are one machine
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="keyfold-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf)
        except Exception:  # noqa: BLE001 -- a core conf may be read-only at runtime
            pass
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def use_rocksdb_state(spark: SparkSession) -> None:
    """The stateful processors need the RocksDB state store provider; with
    changelog checkpointing each batch uploads only its changes (T9, the
    incremental disk state of the reference)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``keyfold`` importable in Python workers (like ``--py-files``).

    Python workers unpickle our functions and processors by module name.
    When the package is not deployed on the workers already, a zip of it is
    written once per application to the shared folder and added with
    ``addPyFile``.  A non-local shared folder (e.g. an object store) is left
    alone: there the package is expected to be shipped by the job submitter.
    """
    import zipfile

    import keyfold

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        _SHIPPED.add(app)
        return
    pkg_dir = os.path.dirname(os.path.abspath(keyfold.__file__))
    zpath = shared_path(spark, "pyfiles") + ".zip"
    os.makedirs(os.path.dirname(zpath), exist_ok=True)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    # Driver-side Python runners (e.g. the pre-init step of stateful
    # processors) take their path from the function's environment.
    env = getattr(sc, "environment", None)
    if env is not None:
        cur = env.get("PYTHONPATH", "")
        env["PYTHONPATH"] = zpath + (os.pathsep + cur if cur else "")
    _SHIPPED.add(app)


def write_table(df, name: str):
    """Write ``df`` to the shared folder and read it back, for several
    consumers of one ordered pass: range bounds are sampled per plan instance,
    so two evaluations could cut different ranges.  Lineage ends here; the
    files survive the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
