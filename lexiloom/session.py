"""Making the package available to a session's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per application.

    Kernels of ``mapInArrow`` and ``mapInPandas`` import it there; on a cluster where it
    is installed on every node this changes nothing.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="lexiloom-")) / "lexiloom.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*")):
                if path.suffix in (".py", ".txt"):
                    archive.write(path, Path(root.name) / path.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
