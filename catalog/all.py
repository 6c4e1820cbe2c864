"""Imports every query module."""

from catalog import scan  # noqa: F401
from catalog import snapshots  # noqa: F401
from catalog import surface  # noqa: F401
from catalog import history  # noqa: F401
from catalog import usage  # noqa: F401
from catalog import whole  # noqa: F401
