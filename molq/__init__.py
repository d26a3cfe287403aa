"""molq: analytics on molecule-level spatial tables, expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from molq.session import build_session

# Task functions travel with their code, so executors need no installed copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
