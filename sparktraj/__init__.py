"""Spark-native analytics for particle-simulation trajectories."""
