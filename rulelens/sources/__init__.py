"""Inputs: corpora from files and tables, changes, rule tables, scorer answers."""
