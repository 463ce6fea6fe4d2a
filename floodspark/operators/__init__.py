"""Joins, aggregations and roll-ups: DataFrame in, DataFrame out, no actions."""
