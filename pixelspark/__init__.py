"""Image-signal analytics over catalogs of images held as Spark tables."""
