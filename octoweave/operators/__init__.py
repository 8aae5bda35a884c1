"""Set-shaped operators over bytes, chunks, counts and records."""
