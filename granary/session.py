"""Session settings shared by bench, tests and queries."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Settings the dialect relies on: identifiers keep their case, arithmetic raises instead of wrapping.
DIALECT = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "granary", **more: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the submitter sets master and memory."""
    conf = DIALECT | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | more
    return SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where written tables go: a folder that all executors share. Only local mode may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="granary-")
