-- Population statements as received
CREATE TABLE `${bronze_db}`.wikidata_population (
  head STRUCT<vars: ARRAY<STRING>>,
  results STRUCT<bindings: ARRAY<STRUCT<population: STRUCT<datatype: STRING, type: STRING, value: STRING>, point_in_time: STRUCT<datatype: STRING, type: STRING, value: STRING>, rank: STRUCT<type: STRING, value: STRING>>>>,
  station_id STRING NOT NULL,
  _batch_id STRING NOT NULL,
  _ingested_at TIMESTAMP NOT NULL,
  _source_file STRING NOT NULL
)
COMMENT 'Population statements as received'
PARTITIONED BY (days(_ingested_at))
TBLPROPERTIES ('layer' = 'bronze', 'write.format' = 'parquet', 'write.compression' = 'zstd');
