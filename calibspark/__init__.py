"""Spark-native calibration-corpus sampling, completion cleaning and paired
benchmark statistics.

Layout:
  functions/  column expressions (hashing, tokens, meta parsing, text, statistics)
  operators/  DataFrame -> DataFrame operators (ordinals, sampling, pairing, ...)
  sources/    readers, writers and the derived fixture views over the given tables
  plans/      composite jobs (calibration recipes, reports, cleaning, ingest)
  streaming/  Structured Streaming forms (incremental filter, quota, ingest)
"""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's functions to Python workers by value, so UDFs and
    task functions work on executors that do not have the package installed
    (no ``--py-files`` needed)."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older pyspark
        pass


_pickle_by_value()
