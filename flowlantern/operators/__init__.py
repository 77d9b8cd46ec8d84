"""DataFrame to DataFrame operators over packets, flows, windows, matches, alerts and logs."""
