"""Operators for preparing training text; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
