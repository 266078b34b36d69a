-- One checked row per station and hour
CREATE TABLE `${silver_db}`.readings (
  station_id STRING NOT NULL,
  observed_at TIMESTAMP NOT NULL,
  temperature_c DOUBLE NOT NULL,
  relative_humidity_pct INT NOT NULL,
  precipitation_mm DOUBLE NOT NULL,
  wind_speed_kmh DOUBLE NOT NULL,
  _batch_id STRING NOT NULL,
  _source_file STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _merged_at TIMESTAMP NOT NULL
)
COMMENT 'One checked row per station and hour'
PARTITIONED BY (days(observed_at))
TBLPROPERTIES ('layer' = 'silver', 'write.format' = 'parquet', 'write.compression' = 'zstd');

ALTER TABLE `${silver_db}`.readings WRITE ORDERED BY station_id, observed_at;
