"""Query plans over the archive's tables and over flat message tables."""
