"""riskloom: transaction-risk analytics as Spark DataFrame operators.

Subpackages
-----------
sources    scans, sinks and the fixture views over the generated tables
functions  column expressions (features, rules, levels, reasons)
operators  DataFrame -> DataFrame operators (prep, cleaning, graph, history, scoring, reports, models)
plans      compositions of operators (preparation workflows, scoring plan, query registry)
streaming  Structured Streaming entry points (stream scoring, live daily risk)

Functions of this package that run on executors are pickled by value, so the workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["session"]
