"""Streams of evaluation rows."""
