"""nodeflow: organise embeddings and texts into semantic nodes with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from nodeflow.params import Params

# the small task functions travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
