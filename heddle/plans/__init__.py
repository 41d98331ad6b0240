"""Bindings of the driver tables to lineage tables, and the registered queries."""
