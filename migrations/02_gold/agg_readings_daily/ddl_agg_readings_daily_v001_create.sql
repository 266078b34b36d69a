-- Daily weather with trends and population
CREATE TABLE `${gold_db}`.agg_readings_daily (
  station_id STRING NOT NULL,
  reading_date DATE NOT NULL,
  hours_observed INT NOT NULL,
  is_complete_day BOOLEAN NOT NULL,
  temperature_min_c DOUBLE NOT NULL,
  temperature_max_c DOUBLE NOT NULL,
  temperature_avg_c DOUBLE NOT NULL,
  temperature_avg_7d_c DOUBLE NOT NULL,
  temperature_change_c DOUBLE,
  relative_humidity_avg_pct DOUBLE NOT NULL,
  precipitation_total_mm DOUBLE NOT NULL,
  wind_speed_max_kmh DOUBLE NOT NULL,
  population BIGINT NOT NULL,
  population_reference_date DATE NOT NULL,
  _built_at TIMESTAMP NOT NULL
)
COMMENT 'Daily weather with trends and population'
TBLPROPERTIES ('layer' = 'gold', 'write.format' = 'parquet', 'write.compression' = 'zstd');

ALTER TABLE `${gold_db}`.agg_readings_daily WRITE ORDERED BY station_id, reading_date;
