"""streaming of vellum."""
