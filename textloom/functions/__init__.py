"""Functions from Column to Column."""
