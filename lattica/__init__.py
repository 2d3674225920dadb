"""lattica: a PySpark-native pivot and analytics engine."""
