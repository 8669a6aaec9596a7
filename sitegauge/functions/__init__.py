"""Column expressions: scalar maths, text rules and planar geometry."""
