"""Relational, text-mining, graph, search and provenance operators."""
