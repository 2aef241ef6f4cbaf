"""The session the engine is meant for: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "relspark", master: str | None = None, **settings) -> SparkSession:
    """A session with SETTINGS, which ``settings`` (dots as double underscores) may override. A cluster's own master and sizes are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where that is unset, a session of one process gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='relspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
