"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, where the application hasn't set them: texts may be long, and a batch is held
#: by the JVM and by the Python worker at once.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, and bounds Arrow batches."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    if getattr(context, "_tidemark_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.abspath(tempfile.mkdtemp(prefix="tidemark-ship-"))  # executors fetch the archive while the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    tree = os.path.join(folder, "tree")
    shutil.copytree(home, os.path.join(tree, os.path.basename(home)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tidemark-sources"), "zip", tree))
    context._tidemark_shipped = True
