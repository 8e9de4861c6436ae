"""Clean annual panels from industrial reporting data, as Spark DataFrame functions."""

from panelforge.constants import DATASET_VERSIONS, LATEST_VERSION, Level

__all__ = ["DATASET_VERSIONS", "LATEST_VERSION", "Level"]
