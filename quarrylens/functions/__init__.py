"""Column builders: values in, Columns out. Nothing here starts a job."""
