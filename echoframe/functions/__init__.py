"""Column expressions: complex algebra, geodesy, radar scalars and windows."""
