"""Writers: GeoJSON features, tables with metadata."""
