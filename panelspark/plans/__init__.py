"""The registered queries over the driver's tables, by subject; importing this registers them all."""

from . import catalog, comparisons, graphs, panels, profiles, reports, reviewers, terms  # noqa: F401
