"""Daily equity-market panels as plain Spark DataFrames.

Subpackages: ``contracts`` (table contracts and header mappings), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame steps), ``sources``
(raw files and the partitioned store), ``plans`` (whole jobs), ``streaming``
(incremental landing) and ``driver`` (registered queries with their SQL).
"""

__version__ = "0.1.0"
