"""Spark-first analysis of bulk public records: sources, profiling, typing, entities, detectors, search, dossiers."""
