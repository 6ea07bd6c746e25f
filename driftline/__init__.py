"""DataFrame-to-DataFrame operators for dated, grouped, owned text."""
