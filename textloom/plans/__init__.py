"""Registered queries of the text-evidence operators and their oracles."""
