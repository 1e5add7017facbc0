"""A session with the settings that the library relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "postmill", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; further settings by keyword, with dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postmill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
