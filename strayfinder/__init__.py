"""Outlier-model selection on Spark: profile datasets, run detectors, recommend models."""

import sys

from pyspark import cloudpickle

from strayfinder.session import local_session

# Functions sent to tasks carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["local_session"]
