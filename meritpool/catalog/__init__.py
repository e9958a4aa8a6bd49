"""Named queries over the star schema, and the same answers as plain SQL."""
