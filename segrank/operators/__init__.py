"""DataFrame -> DataFrame operators, grouped by the inventory families."""
