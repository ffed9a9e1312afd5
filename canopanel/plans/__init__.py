"""Study plans: fixture views and the registered queries with their oracle SQL."""
