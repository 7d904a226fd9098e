"""lexweave: Spark-native analytics over keyed, typed, multi-valued dictionaries."""

__version__ = "0.1.0"
