"""Readers of task pages, mail and files, and writers of tables and outboxes."""
