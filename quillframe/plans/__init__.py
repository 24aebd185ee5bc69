"""Order service and the catalogue of queries."""
