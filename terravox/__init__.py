"""Terravox: spatial and geometric analytics as composable PySpark DataFrame transformations."""
