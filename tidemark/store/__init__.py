"""A snapshot table store on Parquet files, with DDL, maintenance and a stream source."""
