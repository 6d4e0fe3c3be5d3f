"""Training-data operators over text tables; nothing else in the package imports this folder."""
