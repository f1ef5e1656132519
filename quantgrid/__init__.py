"""Cross-sectional panel analytics as plain PySpark DataFrame functions."""
