"""Period drivers and registered queries."""
