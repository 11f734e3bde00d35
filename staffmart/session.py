"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the jobs are written for. Partition counts and sizes belong to the cluster and
# are not set here; adaptive execution coalesces small shuffles and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Above 8,000 bytes of byte code the JVM does not compile a method; wide projections then
    # run faster outside whole-stage code, where Spark splits them into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Plans are built from many small expressions; do not record a call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_local_dirs: dict[str, str] = {}


def build_session(app: str = "staffmart", master: str | None = None, **conf: str) -> SparkSession:
    """Session with SETTINGS; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own. On a cluster a missing
    setting is an error, because a folder of one machine would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="staffmart-")
    return _local_dirs[app]
