"""salesmart — sales-mart jobs and reports on Spark.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver and no Python UDF runs in the hot path.

Layout:
    functions/  column expressions (dates, flags, money, text formats)
    sources/    readers (CSV, JSON rate series, warehouse tables, driver adapter)
    operators/  cleaning, star schema, per-order facts, reports, series,
                forecast, distributions, profiling, change log, payloads
    sinks/      Parquet/CSV/JDBC writers, snapshot append, full refresh
    plans/      query registry (key -> Spark job) and DuckDB oracle SQL
"""

from salesmart.params import Period, Thresholds, Params  # noqa: F401
