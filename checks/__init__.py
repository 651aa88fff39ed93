"""Registered queries over the driver's tables and the tool that checks them."""

from importlib import import_module

MODULES = ["matching_checks", "annotation_checks", "span_checks", "text_checks", "source_checks",
           "format_checks"]


def load():
    from checks import registry

    for name in MODULES:
        try:
            import_module(f"checks.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"checks.{name}":
                raise
    return registry
