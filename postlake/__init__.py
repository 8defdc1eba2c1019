"""Job-posting analytics and training-data operators as PySpark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
