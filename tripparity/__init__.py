"""Training/serving feature parity for taxi trips, built on Spark.

Every operator is a pure ``DataFrame -> DataFrame`` function over native Spark expressions, so the
same code runs over batch tables and Structured Streaming micro-batches.
"""

from tripparity.operators.vector import FEATURE_NAMES

__all__ = ["FEATURE_NAMES"]
