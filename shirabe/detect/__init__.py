"""The rules and the matcher that finds their values in one text."""
