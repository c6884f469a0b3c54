"""chunkloom: content-defined chunking, deduplication and delta analytics as PySpark plans."""

import os


def ensure_importable(spark) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    On a cluster the package is shipped as usual (--py-files or installed); this only adds a path.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
