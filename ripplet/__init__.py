"""Change-impact analytics over typed property graphs, built on PySpark DataFrames."""

from ripplet.model import Graph

__all__ = ["Graph"]
