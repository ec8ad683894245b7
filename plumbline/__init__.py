"""Text analytics over large document collections, as DataFrame plans."""
