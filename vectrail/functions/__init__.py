"""Part of vectrail."""
