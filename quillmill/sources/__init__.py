"""Reading files, tables and manifests; writing chunk tables and modules."""
