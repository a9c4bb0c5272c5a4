"""DataFrame operators: splits, joins, metrics, regression, windows, reshaping, tests and gates."""
