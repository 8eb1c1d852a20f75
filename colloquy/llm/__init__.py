"""Operators for preparing training data: deduplication, filters, scans, tokens and mixing.

Nothing outside this package imports it. Every operator takes a DataFrame with an id and a text
column and reads only the columns that it names, so other columns cannot clash with its own.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
