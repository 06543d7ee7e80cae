"""tillroll: small-business analytics as Spark DataFrame plans.

Layers: ``sources`` (typed reads, landing tables, test-data adapter),
``functions`` (shared column expressions and window patterns),
``operators`` (one function per business question, DataFrame in, DataFrame out),
``plans`` (RAW -> STAGING -> MART pipelines and the query registry),
``streaming`` (incremental refresh of the daily marts).
"""

__version__ = "0.3.0"

__all__ = ["session"]
