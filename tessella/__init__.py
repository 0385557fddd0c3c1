"""Spark-native engine for grid-shaped data: tables, keys, lookups, formulas, quality findings."""
