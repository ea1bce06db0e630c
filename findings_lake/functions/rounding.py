"""Python-exact ``round(x, 2)`` as a Catalyst expression.

Spark's ``round``/``bround`` round the *printed* decimal of a double with
HALF_UP / HALF_EVEN; Python rounds the exact binary value half-to-even.
They differ whenever ``x*100`` lies within float noise of ``k + 0.5``
(e.g. 0.125 -> 0.12 in Python, 0.13 in Spark).

Away from such near-ties ``round(a*100)`` is exact. Near a tie the sign of
``a*1000 - m`` is decided with Dekker's split of ``a`` into two halves whose
products with 1000 are exact in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, Dekker's splitter for doubles


def round2(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    a = F.abs(x.cast("double"))
    m = F.round(a * 1000.0, 0)
    c = F.floor(m / 10.0).cast("double")
    near_tie = (F.abs(a * 1000.0 - m) < F.lit(1e-9)) & (F.pmod(m, F.lit(10.0)) == 5.0)
    t = a * _SPLIT
    hi = t - (t - a)
    lo = a - hi
    s = (hi * 1000.0 - m) + lo * 1000.0
    even = F.when(F.pmod(c, F.lit(2.0)) == 0.0, c).otherwise(c + 1.0)
    tie_val = F.when(s > 0, c + 1.0).when(s < 0, c).otherwise(even)
    mag = F.when(near_tie, tie_val).otherwise(F.round(a * 100.0, 0)) / 100.0
    out = F.when(x < 0, -mag).otherwise(mag)
    return F.when(x.isNull() | F.isnan(x.cast("double")), x.cast("double")).otherwise(out)
