"""Files to datasets, and the catalog that keeps them."""
