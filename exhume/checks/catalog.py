"""All registered queries and oracles."""

from exhume.checks import (  # noqa: F401
    batches,
    carved_files,
    input_output,
    recovered_files,
    sector_maps,
    text_search,
    tool_reports,
)
from exhume.checks.fixtures import ORACLES, QUERIES  # noqa: F401
