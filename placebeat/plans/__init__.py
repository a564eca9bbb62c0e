"""Plans that combine operators: staging, the nine tables, the static job."""
