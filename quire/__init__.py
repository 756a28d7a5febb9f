"""quire: long-document classification by model fusing, as Spark DataFrame operators.

Every public operator takes and returns DataFrames.  The heavy lifting
(chunking, feature counting, gradient steps, parameter averaging, scoring,
metrics) is expressed with built-in Spark SQL functions so Catalyst can prune,
push down and code-generate it.
"""

__version__ = "0.1.0"
