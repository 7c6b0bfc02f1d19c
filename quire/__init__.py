"""quire: mail-to-digest analytics as PySpark DataFrame operators.

Subpackages: ``sources`` (tables, fixture views, readers, sinks), ``functions`` (Column
builders), ``operators`` (DataFrame -> DataFrame operators), ``plans`` (registered queries,
the flagship plan, DuckDB oracle SQL) and ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
