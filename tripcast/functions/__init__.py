"""Reusable column expressions (all JVM-side built-ins, codegen friendly)."""

from tripcast.functions.columns import *  # noqa: F401,F403
