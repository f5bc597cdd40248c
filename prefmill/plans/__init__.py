"""Named jobs and the registered queries."""
