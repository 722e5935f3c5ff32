"""codelattice: code-graph analytics and large-table data processing on PySpark.

Every operator is a function ``DataFrame -> DataFrame``; nothing here collects
an unbounded result to the driver.
"""

__version__ = "0.1.0"
