"""ledgerlens: customer analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame (or, for
fitted models, a small result object); nothing is computed eagerly except
bounded scalars (one-row aggregates, bucket histograms) that steer a plan.
"""

import sys

from pyspark import cloudpickle

from ledgerlens.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]

# Functions that run in Python workers travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
