"""Column expressions, all evaluated inside the JVM unless a docstring says otherwise."""
