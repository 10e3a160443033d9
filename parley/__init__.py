"""Conversation analytics on Spark: intervals, turns, transcripts, catalogues and corpora as DataFrame functions."""
