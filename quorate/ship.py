"""Make a session ready for this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows and bytes that go to a Python worker at once: texts may be long, and memory must be bounded.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_rows(spark: SparkSession, longest: int, most: int = 256) -> Iterator[None]:
    """For what runs within, whose rows have strings of ``longest`` bytes together: Spark looks at all
    columns' bytes at each row that goes to Python, which costs several times what small rows do. Where
    rows have at most ``most`` bytes, their number bounds a batch well enough."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    if longest <= most:
        spark.conf.set(key, str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def ship(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, and send the package's sources to every executor once per
    application."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quorate-")) / "quorate_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(path.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
