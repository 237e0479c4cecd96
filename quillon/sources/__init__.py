"""Where rows come from and go to: catalogued tables, Parquet folders, dump files."""
