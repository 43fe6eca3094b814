"""lodestrata: a Spark-first engine for graph, text, time-series and quality analytics.

Every operator takes and returns DataFrames; Catalyst picks the physical plan.
"""

__version__ = "0.1.0"
