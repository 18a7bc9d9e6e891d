"""Corpus and bibliometric analytics as DataFrame-to-DataFrame operators on Spark."""
