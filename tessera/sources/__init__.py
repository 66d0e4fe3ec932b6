"""Where corpora come from and where their tables are kept."""
