"""Contracts to import: options, storage, a power plant."""
