from .feed import export_schema, start_export_feed

__all__ = ["export_schema", "start_export_feed"]
