"""Live counterparts of the event operators."""
