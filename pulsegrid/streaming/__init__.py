"""The event operators on streams."""
