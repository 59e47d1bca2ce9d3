"""Reading bank files and writing results."""
