-- Where each process has read to.
CREATE TABLE `${ops_db}`.watermarks (
  process STRING NOT NULL,
  source_table STRING NOT NULL,
  snapshot_id BIGINT NOT NULL,
  snapshot_committed_at TIMESTAMP NOT NULL,
  last_run STRING NOT NULL
);
