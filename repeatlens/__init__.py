"""repeatlens: marketplace repeat-purchase analytics as Spark jobs.

Every job is a pure function ``(Marketplace, Scope, params) -> DataFrame``
built from DataFrame/SQL operators and ``pyspark.ml``.  Nothing is
collected to the driver except bounded metadata (category levels,
partition offsets, fitted model summaries).
"""

from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace

__all__ = ["Scope", "Marketplace"]
__version__ = "0.1.0"
