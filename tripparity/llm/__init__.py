"""Training-data operators over text and vectors; nothing else in the package imports this folder."""
