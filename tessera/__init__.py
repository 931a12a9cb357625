"""tessera: distributed data exploration, cleaning, cash-flow analytics and
modelling as lazy PySpark DataFrame functions.

Every public operator is a function ``DataFrame, params -> DataFrame``; nothing
pulls a table to the driver. Where an operator needs a handful of statistics
(min/max, quantiles, distinct category lists) they are computed by one ``agg``
and joined back as a one-row frame, so the plan stays a single lazy job.
"""

__version__ = "0.1.0"
