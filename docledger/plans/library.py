"""Imports every module that registers queries."""

import importlib

MODULES = ("validation", "cells", "joins", "windows", "reports", "costing", "resolve", "documents", "extraction", "memory", "names", "kitchen", "layout", "rows", "regions", "dedupe", "lines", "sheets", "candidates", "headers", "typed", "wiring")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"docledger.operators.{name}")
