"""Part of the palaver engine; see README.md."""
