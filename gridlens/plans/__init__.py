"""Plan-level building blocks: exact ordered layouts for long series."""
