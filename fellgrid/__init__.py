"""fellgrid: gridded location-suitability analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
