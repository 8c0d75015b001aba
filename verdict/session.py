"""Session settings the operators rely on, and a place for files they write."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and a Python worker, where the session names no bound of its own.
BATCH = 4 << 20


def prepare_session(spark: SparkSession) -> SparkSession:
    """Set the options that change results; tuning is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated key in a JSON object takes its last value.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new directory below the shared folder of the cluster.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset, as in local
    tests, a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.gettempdir() + "/verdict-scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that those of long texts take no more memory than those of short ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def give_back() -> None:
    """Return free memory to the system: Arrow and the C library would keep it for the life of the worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it, others do not
    if trim is not None:
        trim(0)
