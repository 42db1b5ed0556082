"""Every operator as a query on the test tables, with its SQL oracle."""

from plumbline.catalogue import data, evaluation, planning, samples
from plumbline.catalogue.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data", "evaluation", "planning", "samples"]
