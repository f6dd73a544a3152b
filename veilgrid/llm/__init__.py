"""Operators of a training-data pipeline (near duplicates, language, extraction, packing, ...).

Nothing else in the library imports this subpackage. Functions that run inside
Spark's Python workers are shipped by value, so executors need only the
installed libraries, not a copy of this repository.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
