"""Privacy-safe analytics on Spark: plans, profiling, protection and guarded queries over one table."""

from hushframe.api import Guard, Result, ScanReport, ask, protect, scan
from hushframe.errors import HushframeError
from hushframe.operators.receipt import Receipt
from hushframe.policy import Policy

__version__ = "0.1.0"
__all__ = ["Guard", "HushframeError", "Policy", "Receipt", "Result", "ScanReport", "ask", "protect", "scan"]
