"""coffer — portfolio ledger, price history and valuation on Spark.

Every public operator is a function from DataFrames to a DataFrame: it
triggers no action, reads no wall clock and registers no Python UDF; the
plans are declared with ``pyspark.sql.functions`` / ``Window`` and handed to
Catalyst as they are. Writers (``operators.upsert.write_upsert``,
``operators.export``), the batch ``jobs`` and the streaming sink are the
places that run jobs.

Canonical column conventions (see ``coffer.schemas``):

* instants are ``TIMESTAMP_NTZ`` holding UTC wall-clock time;
* symbols are lower-case strings;
* quantities, prices and fees are ``DECIMAL(18,8)``.
"""

from coffer.schemas import COINS_DEFAULT, COINS_MAP_DEFAULT  # noqa: F401

__version__ = "0.1.0"
