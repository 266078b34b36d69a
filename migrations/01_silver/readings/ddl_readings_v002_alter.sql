-- Months hold enough rows for a file; old files keep their days until they are rewritten.
ALTER TABLE `${silver_db}`.readings REPLACE PARTITION FIELD days(observed_at) WITH months(observed_at);
