"""Spark-native analytics for high-cadence light curves and text corpora.

``lumicurve.operators`` holds the light-curve operators, ``sources`` the file
readers, ``functions`` scalar column expressions, ``plans`` whole queries and
``streaming`` the Structured Streaming forms.
"""

__version__ = "0.1.0"
