"""DataFrame-to-DataFrame operators. None of them collects rows to the driver."""
