"""The shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_made: list[str] = []  # the temporary folder of this process, once there is one


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Intermediate tables have to outlive executors, so on a cluster this must be a folder that all of them reach: without
    one it is an error. A local session gets a temporary folder, which goes when the process ends. The session itself is
    not changed.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="clientlens-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return _made[0]
