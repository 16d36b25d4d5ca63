"""Functions of columns: identifiers and text."""
