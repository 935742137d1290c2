"""Plans: a question resolved to columns, a period and filters."""
