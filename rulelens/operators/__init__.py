"""Operators over corpora, findings, the verdict cache and the usage log."""
