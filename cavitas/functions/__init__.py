"""Column and scalar functions: units, labels, metrics, argument checks."""
