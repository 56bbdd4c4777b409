"""sources of vellum."""
