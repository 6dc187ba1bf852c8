"""shelfcast: demand-panel, backtest and replenishment analytics as Spark plans.

Every public operator is a function ``DataFrame -> DataFrame`` (or a Column
factory) built from Spark SQL primitives, so Catalyst sees one logical plan
per job and can prune, push down and re-plan it (AQE).
"""

__version__ = "0.1.0"
