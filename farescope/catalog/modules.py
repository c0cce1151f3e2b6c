"""Imports every module that registers queries."""

from farescope.catalog import q_cycles  # noqa: F401
from farescope.catalog import q_diff  # noqa: F401
from farescope.catalog import q_rollups  # noqa: F401
from farescope.catalog import q_reporting  # noqa: F401
from farescope.catalog import q_quality  # noqa: F401
from farescope.catalog import q_market  # noqa: F401
from farescope.catalog import q_compare  # noqa: F401
from farescope.catalog import q_monitor  # noqa: F401
from farescope.catalog import q_forecast  # noqa: F401
from farescope.catalog import q_ingest  # noqa: F401
from farescope.catalog import q_plans  # noqa: F401
from farescope.catalog import q_inventory  # noqa: F401
from farescope.catalog import q_models  # noqa: F401
from farescope.catalog import q_streaming  # noqa: F401
