"""DataFrame operators: graph analytics, influence, rates, sampling and series."""
