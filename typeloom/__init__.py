"""Typed-table analytics on Spark: typed scans, joins, aggregates, patches, diffs, graphs and validation as DataFrame transformations."""
