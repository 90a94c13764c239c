"""Column expressions: no shuffle, no state, usable on batch and streaming frames alike."""
