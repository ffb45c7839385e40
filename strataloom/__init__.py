"""strataloom: a Spark-first engine for generation-stamped graphs, ranked retrieval and knowledge records.

Every operator is a function from DataFrames to a DataFrame; Catalyst picks the physical plan.
"""

__version__ = "0.1.0"
