"""Where pages come from and where tables are kept."""
