"""Session helpers: local sessions for tests/bench, and the checkpoint folder."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in Python workers (pandas/Arrow UDFs pickle
    their functions by module reference): zip the package once and register it
    with ``addPyFile``, which distributes it to every executor.  Skipped when
    the workers can already import it (an installed package)."""
    import importlib.util
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc) if getattr(sc, "_jsc", None) is not None else id(sc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    spec = importlib.util.find_spec("quire")
    installed = spec is not None and spec.origin and "site-packages" in spec.origin
    if not installed:
        out = os.path.join(tempfile.mkdtemp(prefix="quire-py-"), "quire.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for dp, _, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dp, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
        sc.addPyFile(out)
    _SHIPPED[key] = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  On a cluster it is
    set by the deployment and only read here; a local folder is created only
    when nothing is configured and the driver runs all tasks itself (tests,
    local runs): executors elsewhere could not read it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def work_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
