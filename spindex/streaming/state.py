"""Folders for stream state, under the cluster's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from spindex.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder on shared storage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
