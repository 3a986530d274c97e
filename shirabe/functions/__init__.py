"""Column functions, in Catalyst's own expressions wherever these can say it."""
