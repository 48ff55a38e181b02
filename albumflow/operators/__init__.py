"""Relational operators over media files, tags, tracks and places."""
