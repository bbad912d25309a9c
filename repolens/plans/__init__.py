"""Multi-operator plans: indexing, search, questions."""
