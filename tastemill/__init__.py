"""tastemill: recommendation analytics written as Spark DataFrame jobs."""

from tastemill.columns import RatingColumns

__all__ = ["RatingColumns"]
