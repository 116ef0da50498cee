"""Timeline analytics on PySpark: trajectories, time grids, features and evaluation."""
