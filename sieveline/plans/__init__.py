"""A field over its whole life: log, versions, compaction, inspection."""
