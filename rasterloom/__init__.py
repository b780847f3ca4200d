"""Spark-first raster analytics: scene catalogues, pixel algebra and training-corpus operators."""
