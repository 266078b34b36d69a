"""Session set-up for local use, and making this package importable on workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds this package.
HOME = str(Path(__file__).resolve().parent.parent)


def share_code(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find this package: where the driver has it, or in a zip sent to executors elsewhere."""
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "")
    if HOME not in paths.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join([HOME, paths] if paths else [HOME])
        if not context.master.startswith("local"):
            context.addPyFile(_package())
    return spark


def _package() -> str:
    """This package as a zip file on the driver, which Spark sends to executors."""
    package = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    return str(out)


def local_session(name: str = "tidemark", cores: str = "8", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return share_code(builder.getOrCreate())
