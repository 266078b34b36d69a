"""Row-level and set-level operators: rules, deduplication, changes, aggregates, joins."""
