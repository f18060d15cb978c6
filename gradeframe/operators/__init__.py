"""DataFrame operators, to be used with ``df.transform`` or called directly."""
