"""Spark-native geospatial fire-risk analytics."""
from emberline.config import Settings

__all__ = ["Settings"]
