"""Curatrix: catalogue reconciliation and evidence curation on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function; rules, weights and
thresholds are arguments, results are deterministic.
"""

from curatrix.session import build_session

__all__ = ["build_session"]
