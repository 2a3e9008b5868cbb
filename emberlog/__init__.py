"""emberlog: security-log and forensic-timeline analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers may not have this folder on their path: send our functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
