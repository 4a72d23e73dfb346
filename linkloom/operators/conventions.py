"""Files that a framework finds by name and place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import col, stem

#: Fixed values, in the order of the framework's documentation: stems, and whether they count right in an app root alone.
STEMS = {
    "apple-icon": False,
    "default": False,
    "error": False,
    "forbidden": True,
    "global-error": True,
    "global-not-found": True,
    "icon": False,
    "layout": False,
    "loading": False,
    "manifest": True,
    "not-found": False,
    "opengraph-image": False,
    "page": False,
    "robots": True,
    "route": False,
    "sitemap": False,
    "template": False,
    "twitter-image": False,
    "unauthorized": True,
}
#: Below these, app is the name of a package.
CONTAINERS = ("apps", "libs", "modules", "packages")


def app_root_index(path) -> Column:
    """The place, from 1, of the first ``app`` that roots a route tree; 0 if there is none."""
    parts = F.split(col(path), "/")
    marked = F.transform(parts, lambda x, k: (x == "app") & ((k == 0) | ~F.coalesce(F.try_element_at(parts, k), F.lit("")).isin(*CONTAINERS)))
    return F.array_position(marked, True).cast("int")


def is_convention_file(path) -> Column:
    root = app_root_index(path)
    name = stem(path)
    in_root = root == F.size(F.split(col(path), "/")) - 1
    anywhere = [s for s, root_only in STEMS.items() if not root_only]
    return (root > 0) & (name.isin(*anywhere) | (name.isin(*STEMS) & in_root))
