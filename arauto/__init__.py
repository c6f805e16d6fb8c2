"""Notice monitoring on Spark: extraction, de-duplication, matching and digests as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their module code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
