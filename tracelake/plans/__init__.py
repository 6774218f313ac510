"""Plans: registered queries with their SQL, the view cache, and a small task graph for driver-side work."""
