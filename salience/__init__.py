"""Feature-influence analytics expressed as Spark DataFrame, SQL and MLlib jobs."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the closure, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
