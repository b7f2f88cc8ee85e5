"""Session settings that the library's readers and operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None, more: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, UTC, ANSI arithmetic, and Java charsets (windows-1252 input); `more` settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",
        **(more or {}),
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
