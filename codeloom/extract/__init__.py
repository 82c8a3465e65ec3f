"""Pure Python that runs in workers, one source file at a time."""
