-- Hourly weather documents as received
CREATE TABLE `${bronze_db}`.open_meteo_hourly (
  latitude DOUBLE,
  longitude DOUBLE,
  generationtime_ms DOUBLE,
  utc_offset_seconds INT,
  timezone STRING,
  timezone_abbreviation STRING,
  elevation DOUBLE,
  hourly_units STRUCT<time: STRING, temperature_2m: STRING, relative_humidity_2m: STRING, precipitation: STRING, wind_speed_10m: STRING>,
  hourly STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, relative_humidity_2m: ARRAY<INT>, precipitation: ARRAY<DOUBLE>, wind_speed_10m: ARRAY<DOUBLE>>,
  station_id STRING NOT NULL,
  _batch_id STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _source_file STRING NOT NULL
)
COMMENT 'Hourly weather documents as received'
PARTITIONED BY (days(_ingested_at))
TBLPROPERTIES ('layer' = 'bronze', 'write.format' = 'parquet', 'write.compression' = 'zstd');
