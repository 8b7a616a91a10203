"""Network-spatial economic analytics on Spark.

Python functions that run on executors are pickled by value, so a job does not depend on the
package being installed on every worker."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
