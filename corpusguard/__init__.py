"""Corpus text-fidelity analytics on Spark."""
