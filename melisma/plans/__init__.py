"""Queries over the driver's tables and the stand-ins they read."""
