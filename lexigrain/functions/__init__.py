"""Column expressions: text in, text or arrays out, all evaluated in the JVM."""
