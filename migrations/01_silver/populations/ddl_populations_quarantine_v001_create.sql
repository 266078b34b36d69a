-- Rejected statements with every broken rule
CREATE TABLE `${silver_db}`.populations_quarantine (
  station_id STRING,
  point_in_time_raw STRING,
  population_raw STRING,
  rank_raw STRING,
  reference_date DATE,
  population BIGINT,
  rejection_reasons ARRAY<STRING> NOT NULL,
  _batch_id STRING NOT NULL,
  _source_file STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _quarantined_at TIMESTAMP NOT NULL
)
COMMENT 'Rejected statements with every broken rule'
TBLPROPERTIES ('layer' = 'silver', 'write.format' = 'parquet', 'write.compression' = 'zstd');
