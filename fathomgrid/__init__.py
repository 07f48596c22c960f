"""fathomgrid: spatiotemporal overlap analytics for vessel positions, on PySpark."""
