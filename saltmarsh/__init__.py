"""saltmarsh: a Spark-first engine for speech and language-model data work."""

import sys

from pyspark import cloudpickle

# Functions go to the executors whole, so that none of them needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
