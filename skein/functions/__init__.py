"""Column functions on text, paths and markup; all run inside the JVM."""
