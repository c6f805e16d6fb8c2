"""Page, registry, frontier and snapshot sources."""
