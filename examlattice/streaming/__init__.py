"""Event-time jobs with Structured Streaming; each has a batch twin."""
