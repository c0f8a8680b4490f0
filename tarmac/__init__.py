"""tarmac: on-time-performance feature, scoring and evaluation engine on Spark.

Entry points: :mod:`tarmac.plans.pipeline` (staged offline pipeline),
:mod:`tarmac.plans.modeling` (train / evaluate / serve),
:mod:`tarmac.streaming.requests` (streaming request scorer) and
:mod:`tarmac.plans.queries` (the registered queries with DuckDB twins).
"""

__version__ = "0.1.0"
