"""Readers and writers of the event, token and run file formats."""
