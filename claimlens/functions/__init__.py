"""Column expressions: everything here is row-wise and stays JVM-side."""
