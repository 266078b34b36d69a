-- Rejected hours with every broken rule
CREATE TABLE `${silver_db}`.readings_quarantine (
  station_id STRING,
  observed_at_raw STRING,
  observed_at TIMESTAMP,
  temperature_c DOUBLE,
  relative_humidity_pct INT,
  precipitation_mm DOUBLE,
  wind_speed_kmh DOUBLE,
  rejection_reasons ARRAY<STRING> NOT NULL,
  _batch_id STRING NOT NULL,
  _source_file STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _quarantined_at TIMESTAMP NOT NULL
)
COMMENT 'Rejected hours with every broken rule'
TBLPROPERTIES ('layer' = 'silver', 'write.format' = 'parquet', 'write.compression' = 'zstd');
