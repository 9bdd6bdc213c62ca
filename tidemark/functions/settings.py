"""Where data lie: the session's ``tidemark.data.root``, else the environment's TIDEMARK_DATA_ROOT, else the warehouse."""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import SparkSession


class Settings:
    def __init__(self, spark: SparkSession):
        self.root = (
            spark.conf.get("tidemark.data.root", None)
            or os.environ.get("TIDEMARK_DATA_ROOT")
            or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark"
        )

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def processed(self) -> str:
        return f"{self.root}/processed"

    @property
    def cache(self) -> str:
        return f"{self.root}/cache"


def configure_logging(level: str | None = None) -> logging.Logger:
    """The package's logger on stderr; the level comes from the argument or TIDEMARK_LOG_LEVEL."""
    logger = logging.getLogger("tidemark")
    if not logger.handlers:
        logger.addHandler(logging.StreamHandler(sys.stderr))
    logger.setLevel((level or os.environ.get("TIDEMARK_LOG_LEVEL", "INFO")).upper())
    return logger
