"""Training-data operators: search, filters, dedup, decontamination, sharding,
language-model scoring and tokenization. Nothing else in the library imports
this package.

Functions of this package that run in Python workers are pickled by value, so
that executors need the third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
