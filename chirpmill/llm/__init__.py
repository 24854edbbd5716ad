"""Operators for preparing training text; nothing outside this subpackage imports it."""

from __future__ import annotations

from pathlib import Path


def importable(spark) -> None:
    """Let Python workers import this package from where the driver did, on machines that have it at that path.

    Elsewhere the package is installed or given to Spark with ``--py-files``.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
