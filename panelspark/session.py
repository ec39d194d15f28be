"""Session settings and the default parameters shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Analysis windows, cut-offs and thresholds.
ANALYSIS_START = "2015-01-01"
ANALYSIS_END = "2025-12-31"
POST_START = "2020-01-01"
SPARSE_PCT = 30.0
MIN_COVERAGE_PCT = 60.0
MAX_GAP_WEEKS = 8
GAP_BOUNDS = (2, 8)
MIN_ALIGNED_WEEKS = 100
WINSOR_SDS = 5.0
BREAK_MIN_SIZE = 52
MIN_SUBSAMPLE = 60
MAX_VAR_LAGS = 8
PANEL_LAGS = 3
ENSEMBLE_THRESHOLD = 0.65
HIGH_CONFIDENCE = 0.9
NEAR_DUP_COSINE = 0.85
PSEUDO_CONFIDENCE = 0.90

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on to an existing session."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, for a session whose workers can't import it (it is not installed there)."""
    folder = tempfile.mkdtemp(prefix="panelspark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/panelspark", "zip", root.parent, root.name))
    return spark


def local_session(cores: int = 8, name: str = "panelspark") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
