"""Part of panelspark; see README.md."""
