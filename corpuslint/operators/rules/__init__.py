"""Rule families (F-J). Each family is ``fn(tables, cfg) -> issues DataFrame``."""
