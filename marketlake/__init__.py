"""marketlake: Spark operators for market data and for training corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
