"""Runnable jobs over the library: each has a function that takes a session, a command line and a config file."""
