"""Column-to-Column helpers; all of them stay in JVM expressions."""
