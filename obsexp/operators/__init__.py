"""DataFrame operators: cleaning, joins, ordered scans, aggregates, uncertainty, tests, models and frames."""
