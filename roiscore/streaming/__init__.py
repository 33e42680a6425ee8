"""The batch jobs behind a stream of newly arrived images."""
