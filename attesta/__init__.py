"""Spark claim-verification analytics: extraction, overlap scoring, verdicts, evaluation."""
