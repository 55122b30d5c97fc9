"""Whole queries over the tables, each with the SQL that says the same, and the engine that runs sources."""
