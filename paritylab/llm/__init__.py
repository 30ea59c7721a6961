"""Operators for preparing text training data at scale, one module per operator.

Python code of this subpackage travels to the executors by value, inside the
pickled function, so an executor needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
