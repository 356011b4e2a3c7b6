"""DataFrame -> DataFrame operators, grouped by an optional list of series keys."""
