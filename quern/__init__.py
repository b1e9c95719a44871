"""A relational engine on Spark."""
