"""Registered queries: each maps (spark, directory of tables) to a DataFrame, with its SQL where SQL can express it."""
