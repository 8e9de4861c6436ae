"""All registered queries."""

from panelforge.plans import (  # noqa: F401
    linking,
    panels,
    records,
    registers,
    relational,
    repairs,
    typed_tables,
)
from panelforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
