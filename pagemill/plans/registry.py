"""All queries of the core, by name."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from pagemill.plans import made_queries, page_queries, quantity_queries, retrieval_queries

MODULES = [quantity_queries, retrieval_queries, page_queries, made_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once a session; nothing in local mode, where they are importable."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_pagemill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "pagemill")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="pagemill-ship-"), "pagemill.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._pagemill_shipped = True  # type: ignore[attr-defined]
