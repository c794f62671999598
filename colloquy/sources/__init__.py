"""Schemas, readers, the sample-table views and exports."""
