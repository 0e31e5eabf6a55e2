"""Session settings for tests and the benchmark.

On a cluster the session comes from the platform; the operators only assume
AQE is on (runtime broadcast of small join sides by measured size, partition
coalescing, skew-join splitting).  ``checkpoint_dir`` honours the cluster's
``spark.checkpoint.dir`` and only sets a local one where none is configured
(tests).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "funnelkit") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("FUNNELKIT_DRIVER_MEMORY", "8g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in ADAPTIVE.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
