"""Where records come from and where indexes are kept."""
