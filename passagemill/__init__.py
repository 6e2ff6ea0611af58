"""Corpus indexing, search, clustering and refactoring operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to Arrow tasks travel with their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
