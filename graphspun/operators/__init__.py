"""Operators on node and edge tables: nested results, predicates on related rows, ordering, runs, search."""
