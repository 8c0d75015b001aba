"""Where corpora and messages come from, and where results go."""
