"""All registered queries."""

from tallyfloor.catalog import columns, core, files, forecasts, randomization, resampling, tables  # noqa: F401
from tallyfloor.catalog.base import QUERIES, SQL  # noqa: F401
