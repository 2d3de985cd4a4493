"""gridlens — Spark-native analytics for time-stamped measurement series.

Every public operator is a ``DataFrame -> DataFrame`` function (plus
parameters).  Nothing is collected to the driver except schemas, fitted
model parameters and small bounded tables whose size is fixed by a
parameter (grids, rule tables, partition counts).
"""

__version__ = "0.1.0"
