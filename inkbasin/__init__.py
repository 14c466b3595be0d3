"""A PySpark engine for document facts: scan, classify, route, verify, correlate, merge, score and compare."""
