"""operators of vellum."""
