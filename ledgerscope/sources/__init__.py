"""Sources and sinks: supplied tables, ledgers, panels, result documents."""

from ledgerscope.sources.tables import TABLES, read_table
from ledgerscope.sources.ledger import (
    PANEL_SCHEMA, accounts, line_ledger, order_ledger, calendar_bounds,
    ledger_to_panel, line_panel, order_panel,
)

__all__ = [
    "TABLES", "read_table", "PANEL_SCHEMA", "accounts", "line_ledger",
    "order_ledger", "calendar_bounds", "ledger_to_panel", "line_panel",
    "order_panel",
]
