"""Runnable jobs: each a command line, a small configuration file and a function that takes a session."""
