"""volarium: volatility-panel analytics written as DataFrame-to-DataFrame functions on PySpark."""
