"""Trajectory and traffic analytics as lazy PySpark DataFrame programs."""
