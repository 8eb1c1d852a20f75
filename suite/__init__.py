"""Registered queries over the driver tables, each with the SQL that checks it."""

import sys

from pyspark import cloudpickle

from suite import analytics, classification, exploration, prompts, semantics, sources  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

cloudpickle.register_pickle_by_value(sys.modules[__name__])
