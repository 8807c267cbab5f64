"""Multi-pass plans: shared scratch tables, iteration to a fixed point, graph searches, itineraries."""
