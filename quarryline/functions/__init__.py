"""Part of the library; see README.md."""
