"""Registered queries: each takes (spark, sf_dir); each has its SQL beside it where SQL can express it."""
