"""Readers, writers and content-keyed stores."""
