"""riskframe: scored-transaction analytics and model-risk monitoring on Spark.

Operators take and return DataFrames (``riskframe.operators``), read through
``riskframe.sources``, use Column helpers from ``riskframe.functions``, are
registered as queries in ``riskframe.plans`` and stream in
``riskframe.streaming``.
"""

__version__ = "0.1.0"
