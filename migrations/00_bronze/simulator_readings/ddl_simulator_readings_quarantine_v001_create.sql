-- Messages that do not fit the table
CREATE TABLE `${bronze_db}`.simulator_readings_quarantine (
  _message_id STRING NOT NULL,
  body STRING,
  rejection_reasons ARRAY<STRING> NOT NULL,
  _sent_at TIMESTAMP,
  _batch_id STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL
)
COMMENT 'Messages that do not fit the table'
PARTITIONED BY (days(_ingested_at))
TBLPROPERTIES ('layer' = 'bronze', 'write.format' = 'parquet', 'write.compression' = 'zstd');
