"""Structured Streaming forms of ingest, audit, graph and session operators."""
