"""Tables, the catalog, files and durable directories."""
