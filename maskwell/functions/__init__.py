"""See the package docstring in maskwell/__init__.py."""
