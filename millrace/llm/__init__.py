"""Operators for preparing training text at scale, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels with them, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
