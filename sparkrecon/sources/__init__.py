"""Reading and writing text files."""
