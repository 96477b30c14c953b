"""gridloom: gridded and site time-series analytics on Spark."""
