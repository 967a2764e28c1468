"""Operators over files, findings, modules and scores."""
