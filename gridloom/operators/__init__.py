"""Operators on long field tables.

A field is a DataFrame with one row per value: time interval ``t0, t1`` (days), depth ``z0, z1``, cell ``lat0, lat1, lon0,
lon1`` or ``site``, and ``value`` (null: masked; the row stays, so density is known). ``keys`` name the columns that an
operator keeps apart, such as the cell or the model.
"""

CELL = ["lat0", "lat1", "lon0", "lon1"]
