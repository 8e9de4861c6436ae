"""Fixed values the pipelines depend on."""

from __future__ import annotations

import math
from enum import IntEnum

# Published dataset versions, oldest first (name -> folder).
DATASET_VERSIONS = {
    "v1": "1215_Public_Product_Full Access_template_v16_public",
    "v3": "Industrial Reporting Database v3 December 2020",
    "v4": "1215_Public_Product_Full Access_draft_v19_mapping_15_12_21",
    "v6": "1215_Public_Product_Full Access_draft_v19_April_2022_v6",
    "v8": "1215_Public_Product_Full Access_v8",
    "v9": "1215_Public_Product_Full Access_v9_May_2023",
    "v10": "Industrial_dataset_v10_December_2023",
    "v11": "Industrial_dataset_v_11_2024_07_10",
    "v12": "Industrial_dataset_v_12_2024_09_10",
    "v13": "Industrial_dataset_v_13_2024_12_16",
    "v14": "Industrial_dataset_v_14_2025_03_10",
    "v15": "Industrial_dataset_v_15_2025_12_15",
    "v16": "Industrial_dataset_v_16_2026_02_16",
}
LATEST_VERSION = "v16"

# Raw texts that stand for "no value".
NA_VALUES = [
    "CONFIDENTIAL",
    "None",
    "none specified",
    "does not exist",
    "UNNAMED ROAD",
    "n.a.",
    "_",
    "-",
    "--",
    "x",
    "01/00/00 00:00:00",
    "01/01/00 00:00:00",
    "12/31/99 00:00:00",
    "01/02/00 00:00:00",
]

# Fixed value: text format of every date column (two-digit year).
DATE_FORMAT = "MM/dd/yy HH:mm:ss"

# A change of almost 1000x is a kg/tonne/gram mix-up; a repaired value
# may lie this far outside the unit's own range.
UNIT_ERROR_LOG10 = math.log10(900)
RANGE_TOLERANCE = 0.5


class Level(IntEnum):
    """Reporting hierarchy, top down."""

    Site = 1
    Facility = 2
    Installation = 3
    Installation_Part = 4

    @property
    def key(self) -> str:
        return f"{self.name}_INSPIRE_ID"
