"""Sources: table metadata, manifests, storage listings and catalogs as DataFrames."""
