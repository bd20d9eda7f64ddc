"""Readers (responses, codebooks, run tables), sinks and fixture views."""
