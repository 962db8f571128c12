"""Jobs, fixture role views and the registered queries."""
