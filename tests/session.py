"""Local session for tests and benchmarks."""

import os

from pyspark.sql import SparkSession


def make_session(cores: str = "8", partitions: str = "8") -> SparkSession:
    os.environ.setdefault("PYTHONPATH", "")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ["PYTHONPATH"].split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(
            p for p in (root, os.environ["PYTHONPATH"]) if p
        )
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelforge")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
