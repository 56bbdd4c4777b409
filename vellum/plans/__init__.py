"""plans of vellum."""
