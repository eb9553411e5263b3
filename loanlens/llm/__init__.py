"""Operators for training-data pipelines over documents, pages and embeddings."""

import sys

from pyspark import cloudpickle

# workers run these functions without having the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
