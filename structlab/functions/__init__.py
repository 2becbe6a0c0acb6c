"""Column functions: everything here is a Catalyst expression and stays in the JVM."""
