"""Stand-in tables and registered queries."""
