"""End-to-end plans and the queries over the driver tables."""
