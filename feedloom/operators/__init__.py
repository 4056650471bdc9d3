"""DataFrame -> DataFrame operators; none of them collects data to the driver."""
