"""panelcast: leakage-safe day-ahead forecasting of regular time-series panels, written for Spark.

A panel is a DataFrame keyed by ``(series_id, ts)`` where ``ts`` is a TIMESTAMP_NTZ
holding UTC.  Every operator is a lazy DataFrame transformation; see README.md for the map.
"""
