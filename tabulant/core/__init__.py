"""Building blocks shared by the operators: columns, order, lookups, moments."""
