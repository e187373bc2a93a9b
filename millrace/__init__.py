"""Corpus analytics on Spark: scans, dedup, decontamination, packing, mixtures, evaluation statistics."""
