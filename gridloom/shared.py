"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import InvalidOption

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one process, as in local
    tests, a folder of this machine is made and set for the session. On a
    cluster executors wouldn't see it, so there it's an error.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise InvalidOption(f"{KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")
