"""Sources: driver tables as quads, export rules, change messages, control rows."""
