"""Lumengrid: image analytics and corpus preparation as lazy Spark plans."""
