"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions that Spark ships to Python workers are pickled by value, so executors need the third-party
libraries only and not this package.
"""

from pyspark import cloudpickle

import tablewright.llm as _package

cloudpickle.register_pickle_by_value(_package)
