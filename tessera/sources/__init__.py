"""Readers and writers: tables, result files, envelopes, manifests, external services."""
