"""Scalar expressions and fault injection, all built from JVM-side functions."""
