"""Web-corpus and company-record analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their tasks, so that it has to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
