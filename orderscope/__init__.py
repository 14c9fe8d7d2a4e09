"""orderscope: delivery-order dashboard datasets as Spark DataFrames.

Every dataset is a pure function ``DataFrame -> DataFrame`` over one
canonical order fact (see ``orderscope.sources.columns``). Nothing is
collected to the driver except tiny, bounded scalars (histogram bounds).
"""

from orderscope.operators.filters import FilterSpec
from orderscope.session import get_session
from orderscope.sources.columns import canonicalise

__all__ = ["FilterSpec", "canonicalise", "get_session"]
