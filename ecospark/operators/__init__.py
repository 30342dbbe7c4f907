"""DataFrame -> DataFrame operators: resolve, dedup, molgraph, joins, profile, sensitivity, features, models."""
