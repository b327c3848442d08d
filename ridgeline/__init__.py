"""ridgeline: Spark-native process analytics for sensor time series.

Every operator is a DataFrame -> DataFrame (or Column-building) function that
Catalyst can plan; see README.md for the layout.
"""

__version__ = "0.1.0"
