"""The append-only logs of the catalog as streaming sinks."""
