"""protospan: a PySpark-native analytics engine for single-cell proteomics tables."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code with them, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
