"""State kept while events come in."""
