from weekcast.sources.fixtures import fixture_tables
from weekcast.sources.tables import (
    assert_unique,
    catalog_tables,
    preview,
    retail_features,
    retail_sales,
    retail_stores,
    shape,
    single_row,
)

__all__ = ["assert_unique", "catalog_tables", "fixture_tables", "preview", "retail_features",
           "retail_sales", "retail_stores", "shape", "single_row"]
