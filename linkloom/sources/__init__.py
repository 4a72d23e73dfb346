"""Readers of facts: tables, source trees, configurations and manifests."""
