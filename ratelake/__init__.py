"""ratelake: rating analytics on PySpark.

Sub-packages: ``sources`` (table and model I/O), ``functions`` (column
expressions), ``operators`` (quality, enrichment, statistics, dashboard,
model), ``streaming`` (message streams and sinks), ``plans`` (fixture views,
registered queries and their SQL oracles). ``jobs`` chains them into the
prepare / train / score-stream / dashboard programs.
"""

__version__ = "0.1.0"
