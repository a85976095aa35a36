"""Where results go: saved datasets, reports, and the scratch folder."""
