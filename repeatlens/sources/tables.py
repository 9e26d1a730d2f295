"""The canonical marketplace tables a job consumes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from repeatlens.sources.schemas import REQUIRED


@dataclass(frozen=True)
class Marketplace:
    """Seven canonical tables (lazy DataFrames).

    ``order_items`` may carry an optional ``quantity`` column; every other
    column a job needs is listed in ``schemas.REQUIRED``.
    """

    orders: DataFrame
    order_items: DataFrame
    customers: DataFrame
    products: DataFrame
    category_translation: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def validate(self) -> "Marketplace":
        for name, df in self.tables().items():
            missing = [c for c in REQUIRED[name] if c not in df.columns]
            if missing:
                raise ValueError(f"table {name} lacks columns {missing}")
        return self

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temp views."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
