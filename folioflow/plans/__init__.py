"""Plans bind operators to tables. Importing a plan module registers its queries."""

from importlib import import_module

from .catalog import BUILDERS, SQL

MODULES = ("reviews", "registry", "specdiff", "corpus", "names", "toc", "streams", "markup", "files")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def all_builders():
    _load()
    return dict(BUILDERS)


def all_sql():
    _load()
    return dict(SQL)
