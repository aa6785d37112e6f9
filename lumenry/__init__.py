"""Lumenry: analytics over pages, organisations and usage logs, expressed as Spark plans."""
