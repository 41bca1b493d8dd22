"""Where documents and labels come from, and where results go."""
