"""loomcast: Spark-native spatio-temporal event analytics and large-scale data preparation."""

__version__ = "0.1.0"
