"""Distributed operators: panel transforms, instruments, moments."""
