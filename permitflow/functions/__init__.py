"""Scalar functions as Columns; Arrow functions where the JVM has no equivalent."""
