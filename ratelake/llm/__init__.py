"""Training-data operators: search, deduplication, scans, scoring, mixing and sharding.

Every module holds one operator; ``queries`` registers them. Nothing else in
the library imports this sub-package.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
