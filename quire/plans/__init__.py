"""Registered queries; importing the package registers them all."""

from . import catalogue, flow, logs  # noqa: F401
