"""Column helpers shared by the operators: calendar, ratios, labels, exact quantiles."""
