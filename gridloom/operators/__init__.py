"""DataFrame operators: lattices, recall, consolidation, trajectories, horizons, byte statistics, codecs."""
