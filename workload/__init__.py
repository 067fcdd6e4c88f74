"""Metadata relations derived from the benchmark tables, the registered queries over them, and their SQL twins."""
