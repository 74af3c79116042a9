"""Scalar and array functions: identities, signal expressions (JVM) and signal kernels (numpy)."""
