"""Readers of question files and rules for writing what they hold."""
