"""New reference records against a standing index, as a stream."""
