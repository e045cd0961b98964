"""Readers: text, JSON documents and structured batches to metric and log rows."""
