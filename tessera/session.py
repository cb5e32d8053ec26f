"""Session helpers: sane defaults for tests/bench, and the checkpoint folder.

On a cluster the session is built by the user; these helpers never override
settings that are already present.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# switched on in a user's session only where unset (runtime re-planning)
_AQE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# extra defaults of the sessions we build ourselves (tests, bench)
_DEFAULTS = {
    **_AQE,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session.  Only when nothing is set and the master is local
    (tests) do we create a scratch folder of our own; on a cluster an unset
    folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect client: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder is not reliable storage on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that tasks can import it
    from any working directory."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")     # Spark serves it from the driver
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def apply_defaults(spark: SparkSession) -> None:
    """Turn on AQE & skew handling where the user left them unset; nothing
    else in a user's session is touched."""
    for k, v in _AQE.items():
        try:
            cur = spark.conf.get(k, None)
        except Exception:  # noqa: BLE001
            cur = None
        if cur is None:
            try:
                spark.conf.set(k, v)
            except Exception:  # noqa: BLE001 - static conf in a running session
                pass
