"""Part of the terrain engine; see the package docstring."""
