-- One population per station and date
CREATE TABLE `${silver_db}`.populations (
  station_id STRING NOT NULL,
  reference_date DATE NOT NULL,
  population BIGINT NOT NULL,
  is_preferred_rank BOOLEAN NOT NULL,
  _batch_id STRING NOT NULL,
  _source_file STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _merged_at TIMESTAMP NOT NULL
)
COMMENT 'One population per station and date'
TBLPROPERTIES ('layer' = 'silver', 'write.format' = 'parquet', 'write.compression' = 'zstd');

ALTER TABLE `${silver_db}`.populations WRITE ORDERED BY station_id, reference_date;
