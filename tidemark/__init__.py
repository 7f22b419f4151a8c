"""Speech-log analytics as PySpark DataFrame, SQL and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Ship helper functions inside the serialised tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
