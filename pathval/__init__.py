"""Valuation of contracts under uncertainty on Spark: contracts as programs, paths as rows."""


def __getattr__(name: str):
    if name in ("calc", "Engine", "Element", "Contract"):
        from pathval import api

        return getattr(api, name)
    raise AttributeError(name)
