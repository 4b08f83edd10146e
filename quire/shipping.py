"""Sends this package to the executors' Python workers, which may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Of each application, the folder from which the driver serves the file; it goes when the driver ends.
_sent: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's modules as a zip file, served by the driver."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.TemporaryDirectory(prefix="quire-")
    path = os.path.join(os.path.realpath(folder.name), "quire_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    whole = os.path.join(at, name)
                    out.write(whole, os.path.join(os.path.basename(root), os.path.relpath(whole, root)))
    context.addPyFile(path)
    _sent[context.applicationId] = folder
