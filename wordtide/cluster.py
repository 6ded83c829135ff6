"""What a cluster has to know of this package: the code on its workers' path, the shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, unless their path has it.

    Workers inherit PYTHONPATH and, in local mode, the working folder; only elsewhere is it sent.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    sc = spark.sparkContext
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root in paths or (sc.master.startswith("local") and os.getcwd() == root) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="wordtide-"), "wordtide_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Only in local mode, where one machine is all there is, a temporary one stands in for a folder
    that is not named; elsewhere a missing name is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wordtide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
