"""A session with the settings that the operators are written for."""

from __future__ import annotations

import logging
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "lexdrift", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    spark = builder.config(map=defaults | settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once a context.

    Where the package's folder is on PYTHONPATH or is the working folder,
    workers find it themselves; elsewhere Spark hands them a small archive.
    """
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    paths = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if str(home.parent) in paths or getattr(sc, "_lexdrift_shipped", False):
        return
    archive = f"{tempfile.mkdtemp(prefix='lexdrift-')}/lexdrift.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(archive)
    sc._lexdrift_shipped = True


def log_to(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Console and, if a path is given, file logging."""
    logger = logging.getLogger("lexdrift")
    logger.setLevel(level)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
    return logger
