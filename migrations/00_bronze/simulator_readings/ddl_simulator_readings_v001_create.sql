-- Sensor messages as received
CREATE TABLE `${bronze_db}`.simulator_readings (
  event_id STRING,
  station_id STRING,
  observed_at STRING,
  temperature_c DOUBLE,
  relative_humidity_pct INT,
  precipitation_mm DOUBLE,
  wind_speed_kmh DOUBLE,
  _message_id STRING NOT NULL,
  _sent_at TIMESTAMP,
  _batch_id STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL
)
COMMENT 'Sensor messages as received'
PARTITIONED BY (days(_ingested_at))
TBLPROPERTIES ('layer' = 'bronze', 'write.format' = 'parquet', 'write.compression' = 'zstd');
