-- The newest message of each station.
CREATE TABLE `${ops_db}`.latest_readings (
  station_id STRING NOT NULL,
  event_id STRING,
  observed_at STRING NOT NULL,
  temperature_c DOUBLE,
  relative_humidity_pct INT,
  precipitation_mm DOUBLE,
  wind_speed_kmh DOUBLE,
  _sent_at TIMESTAMP
);
