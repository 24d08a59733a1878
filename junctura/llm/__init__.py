"""Training-data operators: dedup, filters, mixing and packing over document tables."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
