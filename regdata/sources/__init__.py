"""Readers, sinks and the table catalog."""
