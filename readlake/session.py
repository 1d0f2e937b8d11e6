"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution (coalescing and skew splitting)."""
    b = SparkSession.builder.master(master).appName("readlake")
    own = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false",
    }
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
