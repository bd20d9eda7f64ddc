"""Column-expression helpers (JVM side, no Python UDFs)."""

from itemspace.functions.hashing import det_uint32, det_unit  # noqa: F401
from itemspace.functions.vector import (  # noqa: F401
    array_dot, array_norm, array_sqdist, elementwise_agg,
)
