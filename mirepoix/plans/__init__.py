"""Operators put together: fixture tables, the two recommenders, the query catalogue and its SQL."""
