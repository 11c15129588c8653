"""Column expressions; all stay on the JVM unless their docstring says otherwise."""
