"""Estate and conversation analytics as plain DataFrame jobs."""
