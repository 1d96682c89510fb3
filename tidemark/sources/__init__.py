"""Where points come from and go to: Parquet measurements, the catalog, and the test tables as points."""
