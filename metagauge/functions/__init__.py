"""Column expressions shared by the operators; all are built-in Spark functions."""

from .columns import *  # noqa: F401,F403
