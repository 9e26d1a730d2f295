from repeatlens.sources.tables import Marketplace  # noqa: F401
from repeatlens.sources.driver_adapter import from_driver_tables  # noqa: F401
from repeatlens.sources.csv_source import read_marketplace_csv, ingest_to_parquet  # noqa: F401
from repeatlens.sources.sinks import write_table, export_tables  # noqa: F401
