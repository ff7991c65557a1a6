"""Operators of a training-data pipeline: chat formatting, toxicity, HTML
extraction, near-duplicate search, quality rules, packing, PII and benchmark
decontamination.  Nothing else in the library imports this subpackage."""
