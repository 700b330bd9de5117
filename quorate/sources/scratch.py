"""Where intermediate files go: the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where none is set, a temporary folder in local mode, as
    in tests; on a cluster that would be one machine's, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="quorate-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/quorate/{label}-{uuid.uuid4().hex}"
