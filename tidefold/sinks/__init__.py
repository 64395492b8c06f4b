"""Fitted models as tables, files and packed bytes, and their scoring."""
