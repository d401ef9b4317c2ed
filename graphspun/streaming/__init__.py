"""The page manifest kept up to date from a stream of entities."""
