"""Multi-operator plans and the tables they keep between stages."""
