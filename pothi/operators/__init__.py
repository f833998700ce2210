"""Relational operators: chunking, retrieval, fusion, validation, deduplication, sampling."""
