"""corpusprep: prepare mixed document collections as Markdown packages with Spark.

Every public operator takes and returns a ``DataFrame`` (or builds a ``Column``),
so a whole corpus conversion is one lazy Catalyst plan per document kind.
"""

from corpusprep.config import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
