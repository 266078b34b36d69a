-- One checked row per station and minute
CREATE TABLE `${silver_db}`.sensor_readings (
  station_id STRING NOT NULL,
  observed_at TIMESTAMP NOT NULL,
  temperature_c DOUBLE NOT NULL,
  relative_humidity_pct INT NOT NULL,
  precipitation_mm DOUBLE NOT NULL,
  wind_speed_kmh DOUBLE NOT NULL,
  event_id STRING,
  _batch_id STRING NOT NULL,
  _message_id STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _merged_at TIMESTAMP NOT NULL
)
COMMENT 'One checked row per station and minute'
PARTITIONED BY (days(observed_at))
TBLPROPERTIES ('layer' = 'silver', 'write.format' = 'parquet', 'write.compression' = 'zstd');

ALTER TABLE `${silver_db}`.sensor_readings WRITE ORDERED BY station_id, observed_at;
