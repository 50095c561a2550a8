"""DataFrame-to-DataFrame operators grouped by SURVEY section."""
