"""Jobs: operators composed end to end."""
