"""Network traffic detection and alert analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
