"""functions of vellum."""
