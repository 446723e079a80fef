"""Bindings of operators to the benchmark tables, with their checking SQL."""
