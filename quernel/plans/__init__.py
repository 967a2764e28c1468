"""Whole analyses, and what their steps share."""
