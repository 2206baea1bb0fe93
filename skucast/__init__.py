"""skucast: retail demand analytics as Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, windows, joins and MLlib.
Python runs inside tasks only for the few small per-group numeric kernels
(batched normal-equation solves, isolation trees, blocked Gram products).
"""

from skucast.schema import KEYS, PANEL_COLUMNS  # noqa: F401
from skucast.session import get_spark  # noqa: F401

__version__ = "0.1.0"
