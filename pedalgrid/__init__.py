"""Fleet availability analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python tasks get our small helpers with the task itself, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
