"""Where data comes from and goes to: snapshots, change logs and the store."""
