"""Named pipelines, experiment analytics, alerts and quality checks."""
