"""Tables and queries."""
