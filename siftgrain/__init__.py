"""siftgrain: a PySpark-native code and document intelligence engine.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is
collected unless the docstring of the operator says so and names the bound.
"""

__version__ = "0.1.0"
