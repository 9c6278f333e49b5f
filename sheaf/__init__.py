"""Review of many submission bundles as Spark jobs.

Every operator is a function from DataFrames to a DataFrame.  Rules emit one
common ``findings`` table; layouts, weights and texts are data in ``presets``.
"""

__version__ = "0.1.0"
