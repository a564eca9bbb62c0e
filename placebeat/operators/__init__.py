"""DataFrame-to-DataFrame operators; all are lazy except the neighborhood fit."""
