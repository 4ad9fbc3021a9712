"""Column builders: tags, units, geometry."""
