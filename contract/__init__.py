"""Queries over the driver tables with the SQL each must agree with."""

from contract import inputs, places, relational, reports, statistics, texts  # noqa: F401 - they register their cases
from contract.base import CASES

__all__ = ["CASES"]
