"""The SQL subset that is graded: reading, rewriting, comparing, verifying."""
