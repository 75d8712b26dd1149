"""Runnable jobs: each is a function over a session, with a command line and a config file beside it."""
