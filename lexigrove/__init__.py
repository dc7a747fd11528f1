"""Lexigrove: dictionary-driven text analytics and corpus work as Spark plans."""
