"""Training-data operators on text, vectors and web pages. Nothing else in the library imports this subpackage."""
