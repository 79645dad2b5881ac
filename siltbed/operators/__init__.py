"""Relational operators over versioned records."""
