"""Lodestone: a catalog analytics engine written as plain Spark DataFrame programs."""
