"""Where transfers come from and where results go."""
