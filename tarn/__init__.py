"""tarn: a small relational engine whose operators are functions from DataFrame to DataFrame.

Scans, filters, joins, single-key aggregation, sorting, a restricted SQL front end and versioned tables
with transactions; Catalyst and adaptive execution choose the physical plan.
"""

import sys

from pyspark import cloudpickle

# What is sent to Python workers travels by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
