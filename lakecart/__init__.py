"""lakecart: a Spark-native commerce analytics toolkit.

Sub-packages:

* ``sources``   – readers/writers (raw CSV lake, curated Parquet, event logs, eval cases, objects)
* ``functions`` – Column-level building blocks (normalisation, money, text guards)
* ``plans``     – declarative query plans (fixture views, sales mart, KPI reports)
* ``operators`` – set-based jobs (search, joins, nested documents, quality, order/stock/payment
                  state, text guards, evaluation)
* ``streaming`` – Structured Streaming twins of the stateful batch jobs

Every public function takes and returns DataFrames (or Columns); nothing collects data
to the driver.
"""

__all__ = ["session"]
