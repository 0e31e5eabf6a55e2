"""Funnel, payment-channel and experiment analytics as Spark DataFrame operators.

Every operator is a plain function ``(tables | DataFrames, Params) -> DataFrame``
built from Spark SQL expressions, so Catalyst and adaptive execution plan the
whole query; nothing is collected inside an operator.
"""

from funnelkit.plans.params import Params

__all__ = ["Params"]
