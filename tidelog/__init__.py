"""tidelog: analytics over ordered, sharded event logs, expressed with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# What runs in Python workers travels with the job, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
