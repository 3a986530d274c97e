"""The engine's registered queries, over the tables of a folder, each with SQL that says the same."""
