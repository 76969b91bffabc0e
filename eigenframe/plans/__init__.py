"""Plan shapes shared by the operators: ordered ranges, exact quantiles, Gram aggregation."""
