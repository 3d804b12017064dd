"""newsloom: news-article enrichment expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's code with them, so that workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
