"""Continuous maintenance of a corpus."""
