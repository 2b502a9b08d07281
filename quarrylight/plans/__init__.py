"""Named queries over the tables, and their SQL twins."""
