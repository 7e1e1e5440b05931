"""fitloom: Spark-native tabular feature, encoding and ensemble operators.

Every operator is a DataFrame -> DataFrame function (or a fit/apply pair whose
fitted state is a small DataFrame) expressed with built-in Spark SQL
functions so that Catalyst plans it and whole-stage codegen runs it.
"""

from fitloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
